"""The k best documents of each query without scoring every match.

Scores are sums over terms of q * u: the weight of a term in the query and in the document, neither below 0. Documents lie in
blocks, a bounded number of them, and the largest u of each of the queries' terms in each block is found first. Two passes: the first scores a few blocks of the
largest bounds, whose k-th score the k best can't fall below; the second leaves out blocks whose bound is below that.
In the others a document has to hold an essential term: the rest, those of the smallest bounds, add up to less than is
needed. Of the documents found by essential terms those go on that can still reach it, and only for them are the other terms
looked up. Results are those of scoring everything.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions.storage import kept_table

#: Documents in a block at least, about; blocks of a table at most, besides one for each length.
BLOCK, BLOCKS = 64, 64
#: Rows of bounds that go to all tasks at most; more are joined by a shuffle.
SENT = 1_000_000


def blocks(docs: DataFrame, length: Column, size: int = BLOCK) -> DataFrame:
    """(doc_id, block) of the documents, length being a number above 0 that their weights fall with. Documents of like length
    share blocks, dealt by hash, so that a short one doesn't raise the bound of long ones. There is a count for each eighth of
    a power of e, a few hundred rows at most, however many documents. Blocks grow with the table, their number is bounded, and so are
    the bounds of a query."""
    bucket = F.floor(F.ln(length) * 8)
    placed = docs.select("doc_id", F.coalesce(bucket, F.lit(0)).alias("_bucket"))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    counts = counts.crossJoin(counts.agg((F.sum("_n") / BLOCKS).alias("_least")))
    within = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / F.greatest(F.lit(float(size)), "_least")))
    return placed.join(F.broadcast(counts), "_bucket").select("doc_id", (F.col("_bucket") * (1 << 40) + within).alias("block"))


@dataclass(frozen=True)
class Passes:
    """seeds(query_id, doc_id, score): scored in the first pass; found(query_id, doc_id, ...): scored in part in the second;
    best(query_id, rank, doc_id, score)."""

    seeds: DataFrame
    found: DataFrame
    best: DataFrame


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def passes(terms: DataFrame, postings: DataFrame, k: int, keys: tuple[str, ...] = ("term",), digits: int = 6, size: int = BLOCK) -> Passes:
    """terms(query_id, keys, q), postings(keys, block, doc_id, u); each of them once for its keys, a document in one block.

    Scores are rounded to so many digits before they rank, ties go to the smaller id. Bounds have a row for each query, term
    and block that holds the term, so they don't grow with the documents. Postings that are dealt by document are scored where they
    lie; pairs of queries and documents aren't shuffled while the bounds go to all tasks.
    """
    slack, names = 10.0**-digits, list(keys)
    impacts = postings.groupBy(*names, "block").agg(F.max("u").alias("top"))
    bounds = kept_table(terms.join(impacts, names).select("query_id", "block", *names, "q", (F.col("q") * F.col("top")).alias("most")))
    by_block = bounds.groupBy("query_id", "block").agg(F.sum("most").alias("bound"))
    # first pass
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block"))
    chosen = by_block.withColumn("_n", nth).where(F.col("_n") <= max(2, math.ceil(2 * k / size))).select("query_id", "block")
    wanted = _sent(kept_table(bounds.join(chosen, ["query_id", "block"]).select("query_id", "block", *names, "q")))
    seeds = postings.join(wanted, [*names, "block"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("q") * F.col("u")), digits).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    least = seeds.withColumn("_n", place).where(F.col("_n") == k).select("query_id", F.col("score").alias("least"))
    # second pass; a query whose first pass has fewer than k documents leaves nothing out
    least = terms.select("query_id").distinct().join(least, "query_id", "left").select("query_id", F.coalesce("least", F.lit(0.0)).alias("least"))
    block = Window.partitionBy("query_id", "block")
    within = bounds.join(least, "query_id").withColumn("bound", F.sum("most").over(block)).where(F.col("bound") + slack >= F.col("least"))
    summed = F.sum("most").over(block.orderBy("most", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = within.withColumn("essential", summed + slack >= F.col("least"))
    within = kept_table(within.withColumn("rest", F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(block)))
    found = postings.join(_sent(within.where("essential")), [*names, "block"])
    found = found.groupBy("query_id", "block", "doc_id").agg(F.sum(F.col("q") * F.col("u")).alias("part"), F.first("rest").alias("rest"), F.first("least").alias("least"))
    going = found.where(F.col("part") + F.col("rest") + slack >= F.col("least")).select("query_id", "block", "doc_id", "part")
    # by document alone, as both sides lie; what isn't of the query falls out by the second join
    other = going.drop("part", "block").hint("shuffle_hash").join(postings, "doc_id")
    rest = _sent(within.where(~F.col("essential")).select("query_id", "block", *names, "q"))
    other = other.join(rest, ["query_id", "block", *names]).groupBy("query_id", "doc_id").agg(F.sum(F.col("q") * F.col("u")).alias("other"))
    whole = going.join(other, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.col("part") + F.coalesce("other", F.lit(0.0)), digits).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    best = whole.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
    return Passes(seeds, found, best)
