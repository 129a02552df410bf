"""What the index and its searches shuffle and keep."""

import pytest
from pyspark.sql import functions as F

from fernglass.functions.storage import written
from fernglass.functions.text import counted
from fernglass.operators import index, ranked, topk

DOCS = [(1, "x x y"), (2, "x z"), (3, "x y don't"), (4, ""), (5, "x x y"), (6, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def _exchanges(df):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Exchange" in line] + [
        line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line
    ]


def test_blocks_are_bounded(spark):
    """bounds have a row for each block, whose number doesn't grow with the documents."""
    placed = topk.blocks(spark.range(20_000).select(F.col("id").alias("doc_id")), F.lit(5.0))
    assert placed.select("block").distinct().count() <= topk.BLOCKS + 1 and placed.count() == 20_000


def test_counts_need_no_shuffle(spark, docs):
    """a document is counted in its row; rows that share a key still count together."""
    assert not _exchanges(index.term_frequencies(docs))
    shared = docs.unionByName(spark.createDataFrame([(1, "y q"), (None, "n")], docs.schema))
    assert {(r.doc_id, r.term): r.tf for r in index.term_frequencies(shared).where("doc_id = 1").collect()} == {(1, "x"): 2, (1, "y"): 2, (1, "q"): 1}
    words = spark.range(1).select(F.inline(counted(F.array(*map(F.lit, ["b", "a", "b", "", "b"])))))
    assert [tuple(r) for r in words.collect()] == [("", 1), ("a", 1), ("b", 3)]


def test_pairs_are_not_shuffled(spark, docs, tmp_path):
    """scores are summed where a document's weights lie."""
    made = index.build_saved(docs, str(tmp_path))
    queries = spark.createDataFrame([(1, "x y"), (2, "z")], "query_id long, query string")
    found = ranked.score(queries, made)
    assert found.count() == 5 and not [line for line in _exchanges(found) if "hashpartitioning(query_id" in line]


def test_postings_are_saved_once(spark, docs, tmp_path):
    """counts and weights are one table, and none has weights by block."""
    index.build_saved(docs, str(tmp_path), by_block=True)
    assert {p.name for p in tmp_path.iterdir()} == {"docs", "postings", "df", "norms", "size", "blocks"}


def test_frequencies_by_two_joins(spark, docs):
    """some terms sent to all tasks, others joined by a shuffle."""
    tf = index.term_frequencies(docs)
    df = index.document_frequencies(tf)
    want = sorted(map(tuple, tf.join(df, "term").select("doc_id", "term", "tf", "df").collect()))
    for most in (1, 4, 1000):
        assert sorted(map(tuple, index.with_frequencies(tf, df, most).collect())) == want
    assert index.with_frequencies(tf.limit(0), df.limit(0)).count() == 0


def test_json_is_compressed(docs, tmp_path):
    """all tables of the export."""
    index.build(docs).export_json(str(tmp_path))
    assert all(list(t.glob("*.json.gz")) for t in tmp_path.iterdir())


def test_postings_by_one_shuffle(spark, docs):
    """counts are shuffled once, with df dealt likewise; terms of many documents in pieces, rows the same."""
    tf, _ = written(index.term_frequencies(docs))
    df, _ = written(index.document_frequencies(tf))
    want = sorted(map(tuple, tf.join(df, "term").select("doc_id", "term", "tf", "df").collect()))
    for task_rows in (1, 2, 3, 4, 1000):
        assert sorted(map(tuple, index.dealt_postings(tf, df, task_rows).collect())) == want
    plan = index.dealt_postings(tf, df, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("hashpartitioning(term") == 2
    assert index.dealt_postings(tf.limit(0), df.limit(0)).count() == 0


def test_norms_join_seldom_terms_no_more(spark, docs):
    """seldom terms come with their frequencies from what is saved, without a shuffle."""
    tf, _ = written(index.term_frequencies(docs))
    df, _ = written(index.document_frequencies(tf))
    joined, _ = written(tf.join(df, "term"))
    for most in (1, 4, 1000):
        found = index.with_frequencies(tf, df, most, joined)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.with_frequencies(tf, df, most).collect()))
        assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_postings(spark, docs):
    """a task sorts a bounded number of rows; no more tasks than rows need."""
    tf = index.term_frequencies(docs)
    df = index.document_frequencies(tf)
    assert index.dealt_postings(tf, df, 1).rdd.getNumPartitions() == 9
    assert index.dealt_postings(tf, df).rdd.getNumPartitions() == 1


def test_tasks_grow_with_pairs(spark, docs, tmp_path, monkeypatch):
    """a task sums a bounded number of pairs of queries and documents."""
    made = index.build_saved(docs, str(tmp_path))
    queries = spark.createDataFrame([(1, "x y"), (2, "z")], "query_id long, query string")
    want = sorted(map(tuple, ranked.search_batch(queries, made).collect()))
    monkeypatch.setattr(ranked, "TASK_PAIRS", 1)
    assert ranked.score(queries, made).rdd.getNumPartitions() == 12
    assert sorted(map(tuple, ranked.search_batch(queries, made).collect())) == want


def test_posting_rows_are_dealt_first(spark, docs):
    """no list is begun before the shuffle, and the number of tasks grows with the texts."""
    tf = index.term_frequencies(docs)
    want = {("x", 0): [1, 2, 3], ("x", 1): [5], ("y", 0): [1, 3], ("y", 1): [5], ("z", 0): [2], ("don't", 0): [3]}
    for parts in (None, 1, 7):
        found = index.posting_blocks(tf, 4, parts)
        assert {(r.term, r.block): r.doc_ids for r in found.collect()} == want
        lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        at = next(i for i, line in enumerate(lines) if "Exchange " in line)
        assert not any("collect_list" in line for line in lines[at:])
    assert index.posting_blocks(tf, 4, 7).rdd.getNumPartitions() == 7
    assert index.text_parts(docs) == 1 and index.text_parts(docs.where("doc_id = 6")) == 1
    long = spark.range(3).select(F.lit("a" * index.TASK_BYTES).alias("text"))
    assert index.text_parts(long) == 3


def test_export_deals_rows_first(spark, docs):
    """no list of the export is begun before its shuffle, and the number of tasks grows with the rows."""
    made = index.build(docs)
    lists, terms = index.postings(made.tf, 7), index.document_terms(made.weights, 7)
    assert {r.term: r.doc_ids for r in lists.collect()} == {"x": [1, 2, 3, 5], "y": [1, 3, 5], "z": [2], "don't": [3]}
    assert {r.doc_id: [tuple(t) for t in r.terms] for r in terms.collect()}[3] == [(1, 1, "don't"), (3, 1, "y"), (4, 1, "x")]
    for found, key in ((lists, "term"), (terms, "doc_id")):
        lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        at = next(i for i, line in enumerate(lines) if f"hashpartitioning({key}" in line)
        assert any("collect_list" in line for line in lines[:at]) and not any("collect_list" in line for line in lines[at:])
        assert found.rdd.getNumPartitions() == 7


def test_parts_are_dealt_straight(spark):
    """no more parts than Spark deals straight into files, unless tasks had too many rows."""
    parts = lambda rows: index.task_parts(spark.createDataFrame([("x", rows)], "term string, df long"))
    assert [parts(n) for n in (0, 2_000_000, 2_000_001, 400_000_000, 900_000_000, 1_500_000_000)] == [1, 1, 2, 200, 200, 300]


def test_export_by_document_once(spark, docs, tmp_path, monkeypatch):
    """tf and weights come from one table of documents, which goes; the weights are those of the index, to the last bit."""
    made, held = index.build_saved(docs, str(tmp_path / "made")), []
    monkeypatch.setattr(index, "written", lambda df, *a: held.append(written(df, *a)) or held[-1])
    made.export_json(str(tmp_path / "json"))
    assert len(held) == 1
    with pytest.raises(Exception, match="(?i)not exist|no such file|not found"):
        held[0][0].count()
    again = index.import_json(spark, str(tmp_path / "json"))
    assert sorted(map(tuple, again.weights.collect())) == sorted(map(tuple, made.weights.collect()))
