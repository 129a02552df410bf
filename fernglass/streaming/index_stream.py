"""Streaming: new documents into an index as they arrive, with the statistics of the whole collection kept as sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fernglass.functions.storage import exists
from fernglass.operators.index import Index, document_frequencies, term_frequencies, term_weights, vector_norms, weighed, with_frequencies
from fernglass.sources.writers import write_table


def append_documents(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text", available_now: bool = True) -> StreamingQuery:
    """Writes the documents of a stream to the tables under path, a folder for each batch.

    A batch that is run again after a failure replaces its own folders, so each document counts once; searches don't see it
    until it is whole. How many documents there are, and how many have a term, are sums over the batches: a batch adds
    its own part and reads the others' parts for its own terms alone. Norms depend on all of these, so a document's norms
    are those of the time it came; see load().
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        def save(name: str, df: DataFrame, *sort: str) -> DataFrame:
            write_table(df, f"{path}/{name}/batch={number}", sort)
            return spark.read.parquet(f"{path}/{name}/batch={number}")

        batch = batch.persist()
        tf = save("tf", term_frequencies(batch, key, text), "term")
        own = save("df", document_frequencies(tf), "term")
        save("size", batch.agg(F.count("*").alias("n")))
        df, size = _sums(spark, path, number)
        save("norms", vector_norms(weighed(with_frequencies(tf, df.join(own.select("term"), "term", "left_semi")), size)))
        # last: a batch without it counts as not there
        save("docs", batch.select(F.col(key).alias("doc_id")))
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _upto(spark: SparkSession, path: str, name: str, last: int) -> DataFrame:
    """The rows of the batches up to the last; folders beyond aren't read."""
    return spark.read.parquet(f"{path}/{name}").where(F.col("batch") <= last)


def _sums(spark: SparkSession, path: str, last: int) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n) over the batches up to the last."""
    df = _upto(spark, path, "df", last).groupBy("term").agg(F.sum("df").alias("df"))
    return df, _upto(spark, path, "size", last).agg(F.sum("n").alias("n"))


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch that is whole. It reads the names of folders. Raises where there is none."""
    return int(spark.read.parquet(f"{path}/docs").select("batch").agg(F.max("batch")).first()[0])


def load(spark: SparkSession, path: str, kept_norms: bool = False) -> Index:
    """The index over all batches that are whole. df, size and weights are always those of now, and a search reads the rows of
    its terms alone from them.

    Norms are made again from all weights, so that scores are those of an index built at once; or, with kept_norms, they are
    read as they were kept: of documents that came before the last refresh() as of then, of others as of their batch.
    Then a search reads its terms and the norms of what it finds, and scores are exact right after a refresh and drift
    with what came since.
    """
    last = last_batch(spark, path)
    docs, tf = (_upto(spark, path, name, last).drop("batch") for name in ("docs", "tf"))
    df, size = _sums(spark, path, last)
    weights = term_weights(tf, df, size)
    norms = _kept_norms(spark, path, last) if kept_norms else vector_norms(weighed(with_frequencies(tf, df), size))
    return Index(docs, tf, df, weights, norms, size)


def refresh(spark: SparkSession, path: str) -> int:
    """Makes the norms of all documents anew and keeps them beside those of the batches; returns the last batch that they
    cover. New batches may come meanwhile. Earlier results of it stay, for searches that still read them."""
    last = last_batch(spark, path)
    df, size = _sums(spark, path, last)
    norms = vector_norms(weighed(with_frequencies(_upto(spark, path, "tf", last).drop("batch"), df), size))
    write_table(norms, f"{path}/fresh/upto={last}")
    return last


def _kept_norms(spark: SparkSession, path: str, last: int) -> DataFrame:
    of_batches = _upto(spark, path, "norms", last)
    if not exists(spark, f"{path}/fresh"):
        return of_batches.drop("batch")
    fresh = spark.read.parquet(f"{path}/fresh")
    upto = fresh.agg(F.max("upto")).first()[0]
    return of_batches.where(F.col("batch") > upto).drop("batch").unionByName(fresh.where(F.col("upto") == upto).drop("upto"))


def read_documents(spark: SparkSession, folder: str, schema: StructType, files: int | None = None) -> DataFrame:
    """Documents of Parquet files as they are put in the folder; files: how many a batch takes at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
