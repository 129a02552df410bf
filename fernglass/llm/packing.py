"""Packing: length buckets of least padding, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_unit, running_before, word_count


def _least(before: np.ndarray, top: np.ndarray, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of before[i] + the padding of a bucket over lengths i..j, for i <= j, and the first such i.

    The padding of a bucket obeys the quadrangle inequality, so the first best i never falls as j rises. The middle j of
    a range is solved, then the halves, each with the i that the middle leaves to it; a level of halves is one vector
    operation, so a bucket costs n log n.
    """
    n = len(top)
    best, start = np.empty(n, np.int64), np.empty(n, np.int64)
    lo, hi, first, last = (np.array([x]) for x in (0, n - 1, 0, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        width = np.minimum(last, mid) - first + 1
        ends = np.cumsum(width)
        i = np.arange(ends[-1]) + np.repeat(first - (ends - width), width)
        j = np.repeat(mid, width)
        cost = before[i] + top[j] * (rows[j + 1] - rows[i]) - (words[j + 1] - words[i])
        best[mid] = np.minimum.reduceat(cost, ends - width)
        at = np.where(cost == np.repeat(best[mid], width), i, n)
        start[mid] = np.minimum.reduceat(at, ends - width)
        lo, hi, first, last = (np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, start[mid]), (start[mid], last)))
        left = lo <= hi
        lo, hi, first, last = lo[left], hi[left], first[left], last[left]
    return best, start


def best_bounds(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """The upper lengths of at most k buckets, by dynamic programming over the histogram.

    lengths, ascending, and how many rows have each. A bucket pads its rows to its upper length. Minimises the padding, in
    whole numbers; of equal plans, takes the one whose last bucket begins first, then the one before it, and so on.
    """
    top, n = np.asarray(lengths, np.int64), len(lengths)
    if n == 0:
        return []
    counts = np.asarray(counts, np.int64)
    rows, words = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * top)])
    cost, came = top * rows[1:] - words[1:], []
    for _ in range(1, min(k, n)):
        cost, start = _least(np.concatenate([[0], cost[:-1]]), top, rows, words)
        came.append(start)
    bounds, j = [], n - 1
    for start in reversed(came):
        bounds.append(int(top[j]))
        j = int(start[j]) - 1
        if j < 0:
            return bounds[::-1]
    return [int(top[j]), *bounds[::-1]]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """Deals documents to padded batches.

    length is the number of tokens, by default the words of the text. Returns key, n_tokens, bucket (int, from 0,
    by rising length), bucket_len (the length that the bucket pads to: the largest in it), batch (bigint, from 0 in
    the bucket) and slot (int, place in the batch). Buckets have the least padding that so many can have. A batch holds
    budget // bucket_len rows, one at least, so a row longer than the budget is a batch of its own; nothing is cut. Rows
    fall into batches in an order given by a hash of the key, then by key and length; equal ones in any order. The
    histogram comes to the driver: 16 bytes for each different length, so never more than for the longest text's length.

    A null or empty text has length 0, and a bucket of length 0 counts as 1 for the budget. Rows with the same key
    get slots of their own. An empty table gives an empty result. Other columns aren't read.
    """
    n = (length if length is not None else word_count(F.col(text).cast("string"))).cast("bigint")
    sized = cut(docs.select(F.col(key).alias(key), F.coalesce(n, F.lit(0)).alias("n_tokens"), hash_unit(F.col(key), F.lit("pack")).alias("_u")))
    histogram = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    bounds = best_bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets) or [0]
    pairs = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(b).cast("bigint").alias("bucket_len")) for i, b in enumerate(bounds)])
    own = F.element_at(F.filter(pairs, lambda p: p["bucket_len"] >= F.col("n_tokens")), 1)
    placed = sized.withColumn("_b", own).select(key, "n_tokens", "_u", F.col("_b.bucket").alias("bucket"), F.col("_b.bucket_len").alias("bucket_len"))
    rows = running_before(placed, ["bucket"], ["_u", key, "n_tokens"], F.lit(1), "_row")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return rows.select(key, "n_tokens", "bucket", "bucket_len", F.floor(F.col("_row") / per).cast("bigint").alias("batch"), (F.col("_row") % per).cast("int").alias("slot"))
