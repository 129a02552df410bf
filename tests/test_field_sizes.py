"""What a fielded index tokenises, and how often."""

from fernglass.operators import fielded


def test_rows_are_tokenised_once(spark, tmp_path):
    """the postings of whole rows are those gathered by a shuffle; statistics come from what is saved."""
    docs = spark.createDataFrame([(1, "b a b", "x"), (2, "", None), (3, None, "x y"), (4, "a", "y")], "doc_id long, t string, u string")
    made = fielded.build(docs, ["t", "u"])
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert rows(made.by_row) == rows(made.postings)
    assert "regexp" not in made.stats._jdf.queryExecution().optimizedPlan().toString()
    made.save(str(tmp_path))
    read = fielded.FieldIndex.load(spark, str(tmp_path))
    assert rows(read.stats) == rows(made.stats) and rows(read.df) == rows(made.df)
    shared = fielded.build(docs.unionByName(docs.limit(1)), ["t"])
    assert shared.by_row is None
