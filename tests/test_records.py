import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fernglass.operators import records
from fernglass.sources import readers, writers

LEFT = "Player string, Height string, Weight string, BornYear string, DraftYear string, College string, HighSchool string, Position string, BornCity string, BornState string, CurrentTeam string, DraftTeam string, DiedYear string"
RIGHT = "player_name string, birth_year string, birth_place string, height_ft string, height_in string, weight_lb string, college string, high_school string, draft_year string, draft_round string, info string"


def left(name, year, height="6-1"):
    return (name, height, "200lb", year, None, "A", "", "QB", "City", "TX", "Team", "Team", "Alive")


def right(name, year, feet="5", inches="9"):
    return (name, year, "Place", feet, inches, "190 lb", "B", "H", "1990", "2", "info")


def test_merge(spark):
    a = spark.createDataFrame([left("Ann Lee", "1980"), left("Bob", "1970"), left("Bob", "1970"), left("Cy", "N/A", "N/A"), left("Dee", None)], LEFT)
    b = spark.createDataFrame([right(" ANN LEE ", "1980"), right("bob", "1970"), right("BOB", "1970"), right("cy", "N/A"), right("dee", None), right("Eve", "1999", "n/a ")], RIGHT)
    out = records.merge_players(a, b)
    rows = out.collect()
    assert out.columns == list(records.MERGED) and all(v is not None for r in rows for v in r)
    by = lambda n: [r for r in rows if r.Player.strip().lower() == n]
    assert len(by("bob")) == 4 and len(by("ann lee")) == 1 and len(by("dee")) == 2  # null years match nothing
    assert by("cy")[0].Height == "N/A" and by("cy")[0].info == "info"  # a left N/A wins
    assert by("eve")[0].Height == "N/A" and by("eve")[0].Position == "N/A" and by("ann lee")[0].HighSchool == ""
    assert [r.Player for r in rows] == sorted(r.Player for r in rows)
    strict = records.merge_players(a, b, na_as_null=True).collect()
    assert len([r for r in strict if r.Player.lower() == "cy"]) == 2


def test_corrupt(spark):
    rows = spark.createDataFrame([(1, "Unknown", "x"), (2, "A", "Unknown Status (Meta Missing)"), (3, "B", None), (4, None, "y")], "doc_id long, Player string, CurrentTeam string")
    assert sorted(r.doc_id for r in records.without_corrupt(rows).collect()) == [3, 4]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("007", 'say "hi", you\nthere'), ("2008-11", None)], "a string, b string")
    writers.write_csv(rows, str(tmp_path / "x"), single_file=True)
    back = readers.read_csv(spark, str(tmp_path / "x"), readers.strings("a", "b"))
    assert sorted(back.collect()) == sorted(rows.collect())
    assert {r.a for r in readers.read_csv(spark, str(tmp_path / "x")).collect()} == {"007", "2008-11"}


def test_row_numbers(spark):
    df = spark.range(0, 50, numPartitions=5).selectExpr("50 - id as k")
    assert [r.doc_id for r in readers.numbered(df, ["k"]).orderBy("k").collect()] == list(range(1, 51))


HOT = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def hot(spark):
    """A session in which a few kilobytes are a large partition."""
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("side", [0, 1])
@pytest.mark.parametrize("common", [None, "Unknown", "alone"])
def test_full_join_splits_hot_keys(hot, side, common, tmp_path):
    """99 in 100 rows of one side without a name, or with one that the other side has once, or not at all."""
    n = 40_000
    many = hot.range(0, n, 1, 16).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("n"), "id")).otherwise(F.lit(common)).alias("k"), F.col("id").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    few = hot.range(300).select(F.when(F.col("id") == 7, "Unknown").otherwise(F.concat(F.lit("n"), F.col("id") * 100)).alias("k"), F.col("id").alias("y"))
    pair = (many, few) if side == 0 else (few, many)
    joined = records.full_join(*pair, ["k"])
    old = pair[0].withColumnRenamed("k", "k1").join(pair[1].withColumnRenamed("k", "k2"), F.expr("k1 = k2"), "outer")
    flat = joined.select("first.*", "second.*").toDF(*old.columns)
    assert flat.exceptAll(old).isEmpty() and old.exceptAll(flat).isEmpty()
    joined.write.parquet(str(tmp_path / "out"))  # a file for each task
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(sizes) == old.count() and max(sizes) <= n / 5


def test_full_join_edges(spark):
    a = spark.createDataFrame([(1, "p"), (None, "q"), (1, "r"), (2, "s"), (1, "p")], "k int, a string")
    b = spark.createDataFrame([(1, "t"), (None, "u"), (3, "v"), (1, "t")], "k int, a string")
    rows = sorted(((r.first and tuple(r.first)), (r.second and tuple(r.second))) for r in records.full_join(a, b, ["k"]).collect() if r.first and r.second)
    assert rows == sorted(((1, x), (1, "t")) for x in "prp" for _ in range(2))
    lone = [(r.first or r.second) for r in records.full_join(a, b, ["k"]).collect() if not (r.first and r.second)]
    assert sorted((r.k is None, r.k or 0, r.a) for r in lone) == [(False, 2, "s"), (False, 3, "v"), (True, 0, "q"), (True, 0, "u")]
    none = a.where("false")
    assert records.full_join(none, b, ["k"]).count() == 4 and records.full_join(a, none, ["k"]).count() == 5 and records.full_join(none, none, ["k"]).count() == 0


def test_rejected_rows(spark, tmp_path):
    """Rows that can't be read are put aside with their reasons, and counted, in one pass."""
    from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

    lines = ["id,name,born,score", '1,"a, ""b""",2001-02-03,1.5', "2,,2001-02-03,", "x,c,2001-02-30,y", "4,d", "5,e,2000-01-01,1,9", '6,"two', 'lines",,2', "", ",,,"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    schema = StructType([StructField("id", LongType()), StructField("name", StringType()), StructField("born", DateType()), StructField("score", DoubleType())])
    checked = readers.read_csv_checked(spark, str(tmp_path / "in.csv"), schema, required=["name"])
    good, bad, totals = writers.write_checked(checked, str(tmp_path / "out"))
    assert [(r.id, r.name, str(r.born), r.score) for r in good.orderBy("id").collect()] == [(1, 'a, "b"', "2001-02-03", 1.5), (6, "two\nlines", "None", 2.0)]
    assert {r.raw for r in bad.where("raw is not null").collect()} == {"4,d", "5,e,2000-01-01,1,9"}
    assert totals["read"] == totals["accepted"] + totals["rejected"] == good.count() + bad.count() and totals["accepted"] == 2
    assert sorted(x for r in bad.collect() for x in r.reasons) == sorted(["name: missing", "id: bigint", "born: date", "score: double", "columns", "columns", "name: missing"])
    # none rejected, and none at all
    for n, text in enumerate(("id,name,born,score\n1,a,,\n", "id,name,born,score\n")):
        (tmp_path / f"{n}.csv").write_text(text)
        good, bad, totals = writers.write_checked(readers.read_csv_checked(spark, str(tmp_path / f"{n}.csv"), schema), str(tmp_path / f"out{n}"))
        assert (good.count(), bad.count()) == (totals["accepted"], totals["rejected"]) == (1 - n, 0)
