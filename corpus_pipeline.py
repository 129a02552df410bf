"""A corpus pipeline of five operators: classify quality, drop recurring lines, keep one of each group of near copies,
mix sources, pack. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernglass.llm import line_templates, mixing, ngram_join, packing, quality
from fernglass.llm.common import kept_table, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that recur across documents."""
    return line_templates.keep_lines(docs)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word shingles are alike."""
    return ngram_join.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, and of each repeat, in the batches."""
    return packing.pack(docs)


#: What run() applies, in this order.
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good),
    ("line_dedup", own_lines),
    ("ngram_jaccard_join", no_copies),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: The classifier and the templates can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
