"""One entry for all queries on an index: Boolean or ranked by what the query holds, results with their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions.weights import STANDARD

from . import boolean, ranked
from .index import Index


def search(index: Index, query: str, k: int = 10, idf: str = STANDARD) -> DataFrame:
    """(rank, doc_id, score, and what the index keeps of a document) of the k first results, in order.

    A query with a word AND, OR or NOT, in any case, is Boolean: its results go by id and their score is null. Any other
    is ranked by cosine. A result whose document isn't in docs is left out; ranks count from 1 before that.
    """
    if boolean.is_boolean(query):
        found = boolean.search_postings(index.tf, index.docs, query).limit(k).withColumn("score", F.lit(None).cast("double"))
    else:
        found = ranked.search(index, query, k, idf)
    # at most k rows: numbered in one place, and sent to all documents
    numbered = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")))
    fields = [c for c in index.docs.columns if c != "doc_id"]
    return index.docs.join(F.broadcast(numbered), "doc_id").select(F.col("rank").cast("bigint").alias("rank"), "doc_id", "score", *fields).orderBy("rank")


def total(index: Index, query: str, idf: str = STANDARD) -> DataFrame:
    """(total): how many results the query has in all, exactly."""
    if boolean.is_boolean(query):
        return boolean.search_postings(index.tf, index.docs, query).agg(F.count("*").alias("total"))
    return ranked.total_hits(index, query, idf)
