"""What the operators share: lineage cuts, whole-corpus ranks and running sums, hashes that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernglass.functions.storage import cut, global_index, kept_table, written

__all__ = ["cut", "fresh", "global_index", "hash_unit", "hash_unit_sql", "identity", "kept_table", "running_before", "small_batches", "table", "word_count", "written"]

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: 13 hexadecimal digits fit a double without rounding.
HASH_DIGITS = 13
HASH_RANGE = float(16**HASH_DIGITS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of rows that goes to Python with whole texts.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends Python batches of at most BATCH_BYTES, or one longer row. Spark's own bound is ten
    thousand rows or 64 MB, of which a worker and the JVM hold several at once, in and out. A lower bound stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = conf.get(name, f"{64 << 20}b").removesuffix("b")
    if not own.isdigit() or not 0 < int(own) <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until it is none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def identity(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns. Rows that agree in both are taken for equal, and equal rows are
    interchangeable; so a row is found again by them where keys are null or repeated. Columns of nested types count as
    their JSON text, and which columns are null counts, too, as the hashes pass over nulls."""
    parts = [F.to_json(F.struct(f"`{f.name}`")) if any(t in f.dataType.simpleString() for t in ("<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema]
    nulls = F.array(*[p.isNull() for p in parts])
    return [F.xxhash64(nulls, *parts), F.xxhash64(F.lit("again"), nulls, *parts[::-1])]


def word_count(text: Column) -> Column:
    """Words in the text as bigint; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_unit(*parts: Column) -> Column:
    """A uniform value in (0, 1) that depends on nothing but the parts, written as strings and joined by ':'.
    Null counts as an empty string. MD5, because every SQL engine has it."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(HASH_RANGE)


def hash_unit_sql(*parts: str) -> str:
    """The same value in DuckDB's SQL."""
    text = " || ':' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return f"((cast('0x' || substr(md5({text}), 1, {HASH_DIGITS}) as bigint) + 0.5) / {HASH_RANGE!r})"


def running_before(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows that come earlier in the same group (bigint, 0 for the first).

    No group is brought together: rows are range-partitioned by group and order, so a group that holds a third of
    all rows covers a third of the partitions. Sums run inside the pieces of groups that the partitions hold, and
    each piece then gets the total of those before it; there are at most groups + partitions pieces. df should be
    narrow; it is computed twice (once for the range bounds), so cut() it first if it is dear.
    """
    keys = [*groups, *order]
    at = cut(df.withColumn("_v", value.cast("bigint")).repartitionByRange(*keys).withColumn("_piece", F.spark_partition_id()))
    totals = at.groupBy(*groups, "_piece").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_piece").alias("_p"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*groups, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = at.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = F.col("_piece") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = local.join(offsets, same, "left")
    return out.withColumn(name, F.col("_in") + F.col("_off")).drop("_v", "_piece", "_in", "_off", "_p", *[f"_g{i}" for i in range(len(groups))])
