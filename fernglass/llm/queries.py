"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernglass.functions.text import once

from . import alignment, chat, line_templates, mixing, near_vectors, neighbours, ngram_join, packing, periodic_runs, quality, sharding, toxicity, urls
from .common import WORD, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_texts(table(spark, sf_dir, "documents"))


def op4_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings; the digests are of what is read back from the formatted text."""
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    made = chat.format_chats(rows)
    turns, learnt = chat.texts(F.col("formatted")), F.array_join(chat.under_loss(F.col("formatted"), F.col("loss")), "")
    read = made.select("conv_id", "formatted", turns.alias("turns"), learnt.alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): of every tenth document, by crc32 of its key, the words from one on repeat themselves; the others are as they
    were."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):  # noqa: ANN001, ANN202
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col(text))

    planted = once(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), repeated)
    return docs.select(F.col(key), F.when((h % 10 == 0) & F.col(text).isNotNull(), planted).otherwise(F.col(text)).alias(text))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted_runs(table(spark, sf_dir, "documents")))
    # the largest struct is the longest run, of those the first, of those the one of the smallest period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("best", longest).withColumns({"start": -F.col("best.back"), "length": F.col("best.length"), "period": -F.col("best.short")})
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period", F.floor(F.lit(1000) * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    found = (
        op1_embedding_near_dedup, op2_url_filter, op3_ngram_join, op4_length_packing, op5_source_mixing, op6_quality_classifier, op7_sharding, op8_line_dedup, op9_nearest_neighbours, op10_toxicity,
        op11_token_alignment, op12_chat_format, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
