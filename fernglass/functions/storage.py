"""Results that are kept for a while: lineage cuts and tables in the folder that all executors share, and row numbers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or the context's checkpoint folder. Where neither is
    set, a local session gets a folder of its own until it ends; on a cluster, whose executors couldn't see that, it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fernglass-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that a lost executor costs no more than the reading of its
    files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> tuple[str, Callable[[], None]]:
    """A path of its own in the shared folder, and what deletes it; it goes when the application ends at the latest."""
    path = f"{shared_folder(spark).rstrip('/')}/fernglass-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(at)
    return path, lambda: files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def keys_are_shared(df: DataFrame, key: str) -> bool:
    """Whether two rows have the same key, by a job over the keys alone."""
    return not df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least, for work that is long for each row of a small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, compression: str | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """df as a Parquet table in the shared folder, and what deletes it. compression: a codec's name. Unlike a checkpoint it has the size of its files as
    statistics; those of checkpoints multiply from join to join, which loops can't bear."""
    path, free = scratch(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), free


def kept_table(df: DataFrame) -> DataFrame:
    """The same for a table that is needed until the application ends."""
    return written(df)[0]


def global_index(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Adds the row's place (bigint, from start) in the order of the whole table, from a range sort and the row counts
    of its partitions; the table of counts has a row for each partition. An empty table stays empty."""
    at = cut(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    piece, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(piece.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_off"))
    return at.join(F.broadcast(offsets), piece == F.col("_p")).withColumn(name, place + F.col("_off")).drop("_m", "_p", "_off")
