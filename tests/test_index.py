import math

import pytest

from fernglass.functions.weights import idf_probabilistic, idf_standard, log_tf
from fernglass.operators import index, ranked
from fernglass.streaming import index_stream

DOCS = [(1, "x x y"), (2, "x z"), (3, "x y don't"), (4, ""), (5, "x x y"), (6, None)]


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    return index.build(docs)


def test_tables(made):
    assert {(r.doc_id, r.term): r.tf for r in made.tf.collect()} == {
        (1, "x"): 2, (1, "y"): 1, (2, "x"): 1, (2, "z"): 1, (3, "x"): 1, (3, "y"): 1, (3, "don't"): 1, (5, "x"): 2, (5, "y"): 1,
    }
    assert {r.term: r.df for r in made.df.collect()} == {"x": 4, "y": 3, "z": 1, "don't": 1}
    assert made.size.first().n == 6
    assert {r.term: r.doc_ids for r in index.postings(made.tf).collect()}["x"] == [1, 2, 3, 5]
    assert [r.term for r in index.vocabulary(made.df).collect()] == ["don't", "x", "y", "z"]


def test_weights_and_norms(made):
    w = {(r.doc_id, r.term): r for r in made.weights.collect()}
    assert w[1, "x"].w_standard == pytest.approx((1 + math.log(2)) * math.log(6 / 5))
    assert w[1, "x"].w_probabilistic == 0  # in more than half of the documents
    assert w[2, "z"].w_probabilistic == pytest.approx(math.log(5))
    norms = {r.doc_id: r for r in made.norms.collect()}
    assert set(norms) == {1, 2, 3, 5}
    for d in norms:
        assert norms[d].n_standard ** 2 == pytest.approx(sum(r.w_standard**2 for (i, _), r in w.items() if i == d))


def test_idf_edges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, 4), (4, 4), (3, 4), (1, 4)], "df long, n long")
    got = [(r.s, r.p) for r in rows.select(idf_standard(F.col("df"), F.col("n")).alias("s"), idf_probabilistic(F.col("df"), F.col("n")).alias("p")).collect()]
    assert got[0] == (0, 0) and got[1][0] < 0 and got[1][1] == 0 and got[2] == (0, 0) and got[3][1] == pytest.approx(math.log(3))
    assert spark.range(1).select(log_tf(F.lit(0))).first()[0] == 0


def test_ranked(made):
    assert [(r.doc_id, r.score) for r in ranked.search(made, "x x y").collect()][:2] == [(1, 1.0), (5, 1.0)]  # copies tie by id
    assert ranked.search(made, "?").count() == 0 and ranked.search(made, "unknown").count() == 0
    assert ranked.total_hits(made, "x").first().total == 4
    assert ranked.search(made, "y", idf="no such method").collect() == ranked.search(made, "y").collect()
    assert all(-1 <= r.score <= 1 for r in ranked.search(made, "x y z").collect())


def test_save_and_load(spark, made, tmp_path):
    made.save(str(tmp_path))
    assert ranked.search(index.Index.load(spark, str(tmp_path)), "z").collect() == ranked.search(made, "z").collect()


def test_build_saved(spark, made, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    saved = index.build_saved(docs, str(tmp_path))
    for name in index.Index.TABLES:
        rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
        assert rows(getattr(saved, name)) == rows(getattr(made, name)), name


def test_json(spark, made, tmp_path):
    made.export_json(str(tmp_path))
    weights = {r.doc_id: r.standard.asDict() for r in spark.read.json(f"{tmp_path}/weights").collect()}
    assert weights[2]["z"] == pytest.approx(math.log(3)) and set(weights) == {1, 2, 3, 5}
    assert {r.term: r.doc_ids for r in spark.read.json(f"{tmp_path}/postings").collect()}["y"] == [1, 3, 5]


def test_entry(made):
    from fernglass.operators import search

    assert [(r["rank"], r.doc_id, r.score) for r in search.search(made, "x NOT y").collect()] == [(1, 2, None)]
    assert [(r["rank"], r.doc_id) for r in search.search(made, "z x", 2).collect()][0] == (1, 2) and search.search(made, "or").count() == 0
    assert search.total(made, "y or z").first().total == 4 and search.total(made, "z").first().total == 1 and search.search(made, "").count() == 0


def test_stream(spark, made, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.where("doc_id < 3").write.parquet(str(tmp_path / "in/a.parquet"))
    docs.where("doc_id >= 3").write.parquet(str(tmp_path / "in/b.parquet"))
    stream = index_stream.read_documents(spark, str(tmp_path / "in/*"), docs.schema)
    index_stream.append_documents(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert ranked.search(index_stream.load(spark, str(tmp_path / "out")), "x y z").collect() == ranked.search(made, "x y z").collect()


def _rows(df):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())


def test_ten_batches(spark, tmp_path):
    """As an index built at once; a search reads its terms alone; kept norms are exact after a refresh; half a batch isn't seen."""
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 5)) + (" all" if i % 3 else "")) for i in range(40)]
    made = index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    for b in range(10):
        spark.createDataFrame(docs[b * 4 : b * 4 + 4], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{b}.parquet"))
    path = str(tmp_path / "out")
    stream = index_stream.read_documents(spark, str(tmp_path / "in/*"), spark.createDataFrame([], "doc_id long, text string").schema, 1)
    index_stream.append_documents(stream, path, str(tmp_path / "state")).awaitTermination()
    assert index_stream.last_batch(spark, path) == 9
    got = index_stream.load(spark, path)
    for name in ("docs", "tf", "df", "size", "weights"):
        assert _rows(getattr(got, name)) == _rows(getattr(made, name)), name
    want = ranked.search(made, "w1 w3 all").collect()
    assert ranked.search(got, "w1 w3 all").collect() == want and want
    # no refresh yet: norms are of the time of each batch, those of the last batch are exact
    kept = index_stream.load(spark, path, kept_norms=True).norms
    assert kept.count() == made.norms.count() and _rows(kept) != _rows(made.norms)
    assert _rows(kept.where("doc_id >= 36")) == _rows(made.norms.where("doc_id >= 36"))
    assert index_stream.refresh(spark, path) == 9
    fresh = index_stream.load(spark, path, kept_norms=True)
    assert _rows(fresh.norms) == _rows(made.norms) and ranked.search(fresh, "w1 w3 all").collect() == want
    scans = [line for line in ranked.search(fresh, "w1 w3")._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
    of_terms = [line for line in scans if "term#" in line]
    assert of_terms and all("In(term, [w1,w3])" in line for line in of_terms)
    assert not [line for line in scans if line not in of_terms and ("tf#" in line or "df#" in line)]
    # a batch that hasn't come to its end
    made.tf.write.parquet(f"{path}/tf/batch=10")
    made.df.write.parquet(f"{path}/df/batch=10")
    assert ranked.search(index_stream.load(spark, path), "w1 w3 all").collect() == want


def test_import_json(spark, made, tmp_path):
    made.export_json(str(tmp_path))
    again = index.import_json(spark, str(tmp_path))
    for name in ("docs", "tf", "df", "weights", "norms", "size"):
        assert _rows(getattr(again, name)) == _rows(getattr(made, name)), name
    assert _rows(index.import_json(spark, str(tmp_path), "doc_id long").docs) == _rows(made.docs)
    assert ranked.search(again, "x y z").collect() == ranked.search(made, "x y z").collect()


def test_search_of_nothing(made):
    assert ranked.search(made, None).count() == 0 and ranked.total_hits(made, "").first().total == 0


def test_hot_term_is_split(spark, tmp_path):
    """A term that half of all rows have is several tasks and files; a rare one is in one."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from fernglass.sources.writers import write_table

    n = 200_000
    term = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, "warm").otherwise(F.concat(F.lit("t"), (F.col("id") % 5_000).cast("string")))
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("doc_id"), term.alias("term"), F.md5(F.col("id").cast("string")).alias("pad"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_table(rows, str(tmp_path / "split"), ["term", "doc_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    write_table(rows, str(tmp_path / "cut"), ["term"], file_rows=30_000)
    for name, most in (("split", n // 4), ("cut", 30_000)):
        files = [pq.read_metadata(f) for f in (tmp_path / name).glob("*.parquet")]
        assert max(f.num_rows for f in files) <= most and sum(f.num_rows for f in files) == n
        assert spark.read.parquet(str(tmp_path / name)).exceptAll(rows).isEmpty()
    tables = [pq.read_table(f) for f in (tmp_path / "split").glob("*.parquet")]
    for t in tables:
        keys = list(zip(t["term"].to_pylist(), t["doc_id"].to_pylist(), strict=True))
        assert keys == sorted(keys)
    assert sum("hot" in t["term"].to_pylist() for t in tables) > 1


@pytest.mark.parametrize("idf", ["standard", "probabilistic"])
def test_best_without_scoring_all(spark, tmp_path, idf):
    """By blocks: the rows of scoring everything, and fewer than half of the pairs scored, even in part."""
    docs, queries = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    made = index.build_saved(docs, str(tmp_path), by_block=True)
    args = {"key": "item_id", "text": "text", "idf": idf}
    row = lambda r: (r.query_id, r["rank"], r.doc_id, r.score)
    for k in (1, 10):
        assert sorted(map(row, ranked.search_batch(queries, made, k, prune=True, **args).collect())) == sorted(map(row, ranked.search_batch(queries, made, k, **args).collect()))
    done = ranked.best_passes(queries, made, 10, idf, "item_id", "text")
    scored = done.seeds.select("query_id", "doc_id").union(done.found.select("query_id", "doc_id")).distinct().count()
    assert scored < 0.5 * ranked.score(queries, made, **args).count()


def test_best_edges(spark, tmp_path):
    """Ties, copies, unknown terms, empty queries, terms in all documents, documents without a vector."""
    import random

    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("a b c d e f common rare".split()) for _ in range(rnd.randint(0, 9))) + " every") for i in range(300)] + [(400, None), (401, ""), (402, "every"), (403, "a b"), (404, "a b")]
    made = index.build_saved(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), by_block=True)
    queries = spark.createDataFrame([(1, "a b"), (2, "rare every"), (3, "nothing"), (4, ""), (5, None), (6, "every"), (7, "a a a f")], "query_id long, query string")
    row = lambda r: (r.query_id, r["rank"], r.doc_id, r.score)
    for k in (3, 50, 500):
        assert sorted(map(row, ranked.search_batch(queries, made, k, prune=True).collect())) == sorted(map(row, ranked.search_batch(queries, made, k).collect()))
