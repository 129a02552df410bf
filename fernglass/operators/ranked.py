"""Ranked retrieval by the cosine of TF-IDF vectors."""

from __future__ import annotations

import logging
import math
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions.storage import kept_table
from fernglass.functions.text import tokenize, tokens
from fernglass.functions.weights import PROBABILISTIC, STANDARD, idf_probabilistic, idf_standard, log_tf

from .index import Index
from .topk import Passes, passes

#: Scores are rounded to this many digits before they rank, so that copies tie whatever the order of summing.
DIGITS = 6
#: Pairs of queries and documents that a task sums at most, about; parts at most (beyond, tasks have more pairs, and may spill).
TASK_PAIRS, PARTS = 1_000_000, 10_000


def idf_method(name: str) -> str:
    """The name, or 'standard' with a warning for one that isn't known."""
    if name in (STANDARD, PROBABILISTIC):
        return name
    logging.getLogger(__name__).warning("unknown IDF method %r: using %r", name, STANDARD)
    return STANDARD


def query_vectors(queries: DataFrame, index: Index, idf: str, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, q, q_norm): weights of the query's terms and the length of its vector. Unknown terms weigh 0."""
    method = idf_standard if idf_method(idf) == STANDARD else idf_probabilistic
    counts = queries.select(F.col(key).alias("query_id"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    known = counts.join(index.df, "term", "left").crossJoin(F.broadcast(index.size))
    weighted = known.select("query_id", "term", (log_tf(F.col("tf")) * method(F.coalesce("df", F.lit(0)), F.col("n"))).alias("q"))
    return weighted.withColumn("q_norm", F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("query_id"))))


def _dealt(index: Index, method: str, parts: int | None = None) -> DataFrame:
    """(doc_id, term, w, norm), dealt by document, in so many parts: what follows for each document needs no other shuffle.
    Norms, the smaller side, are hashed; weights aren't sorted."""
    by = lambda df: df.repartition(parts, "doc_id") if parts else df
    norms = by(index.norms.select("doc_id", F.col(f"n_{method}").alias("norm")).where("norm > 0"))
    return by(index.weights.select("doc_id", "term", F.col(f"w_{method}").alias("w"))).join(norms.hint("shuffle_hash"), "doc_id")


def _of_terms(index: Index, terms: DataFrame) -> Index:
    """The index with the weights of these terms alone; Spark sends the terms to all tasks while they are few."""
    return replace(index, weights=index.weights.join(terms.select("term").distinct(), "term", "left_semi"))


def _scored(q: DataFrame, index: Index, method: str, parts: int | None = None) -> DataFrame:
    dots = _dealt(index, method, parts).join(q, "term").groupBy("query_id", "doc_id")
    sums = dots.agg(F.sum(F.col("q") * F.col("w")).alias("dot"), F.first("q_norm").alias("q_norm"), F.first("norm").alias("norm"))
    return sums.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("q_norm") * F.col("norm")), DIGITS).alias("score"))


def score(queries: DataFrame, index: Index, idf: str = STANDARD, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, doc_id, score) of each document that holds a term of the query and has a vector. Scores of 0 count.
    The queries' vectors are kept as a table, whose size tells whether it goes to all tasks. Then weights of their terms are
    dealt by document once, and scores are summed there: pairs of queries and documents aren't shuffled. There are so many
    parts that a task's pairs stay in memory, however many documents."""
    method = idf_method(idf)
    q = kept_table(query_vectors(queries, index, method, key, text).where("q_norm > 0"))
    pairs = q.select("query_id").distinct().count() * index.size.first()[0]
    return _scored(q, _of_terms(index, q), method, min(PARTS, math.ceil(pairs / TASK_PAIRS)) if pairs > TASK_PAIRS else None)


def _score_one(index: Index, query: str, idf: str) -> DataFrame:
    """The same of one query, whose terms are read by name, so that the files' own statistics tell which parts hold them."""
    method, few = idf_method(idf), index.of_terms(tokens(query))
    one = index.size.select(F.lit(0).alias("query_id"), F.lit(query).alias("query"))
    return _scored(F.broadcast(query_vectors(one, few, method).where("q_norm > 0")), few, method)


def search(index: Index, query: str, k: int = 10, idf: str = STANDARD) -> DataFrame:
    """(doc_id, score): the k best documents, ties by id. A query without tokens, or of weight 0, gives none."""
    return _score_one(index, query, idf).select("doc_id", "score").orderBy(F.col("score").desc(), "doc_id").limit(k)


def search_batch(queries: DataFrame, index: Index, k: int = 10, idf: str = STANDARD, key: str = "query_id", text: str = "query", prune: bool = False) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query. prune leaves out what can't be among them (see
    topk), on an index with blocks: it reads and scores less, in more and smaller steps, which pays where terms have many
    more documents than blocks. Both ways give the same rows."""
    if prune:
        return best_passes(queries, index, k, idf, key, text).best
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = score(queries, index, idf, key, text).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def best_passes(queries: DataFrame, index: Index, k: int, idf: str = STANDARD, key: str = "query_id", text: str = "query") -> Passes:
    """The passes of a search for the k best. A weight is the product of a count's and a term's, the same in query and document,
    so magnitudes multiply to what the weights do."""
    method = idf_method(idf)
    vectors = query_vectors(queries, index, method, key, text).where("q_norm > 0")
    terms = kept_table(vectors.select("query_id", "term", F.abs(F.col("q") / F.col("q_norm")).alias("q")))
    dealt = _dealt(_of_terms(index, terms), method).join(index.blocks.hint("shuffle_hash"), "doc_id")
    postings = dealt.select("term", "block", "doc_id", F.abs(F.col("w") / F.col("norm")).alias("u"))
    return passes(terms, postings, k, ("term",), DIGITS)


def total_hits(index: Index, query: str, idf: str = STANDARD) -> DataFrame:
    """(total): how many documents score() gives, exactly."""
    return _score_one(index, query, idf).agg(F.count("*").alias("total"))
