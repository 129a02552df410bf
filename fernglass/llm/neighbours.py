"""Approximate nearest neighbours: collision-counting hashing.

Each hash is one projection. The rows of a tile are sorted by each of m projections; a query opens a window around its
own value in each sorted array, that is a range of ranks, and a row collides as often as its rank lies in a window.
Windows are tied to a radius: for a row within the radius, the share of windows it lies in is known, and so is a number of
collisions that it reaches with a given probability. Rows that reach it are verified with their exact cosine. While the
k-th best row found is farther away than the radius, the radius grows and the windows with it (virtual rehashing). The
first radius is that of the k-th neighbour of a few rows of the tile. Past radius 2, where all unit vectors lie, the
rest is verified, so fewer than k rows are never missed.

Rows are dealt once, at random, to tiles; a tile is indexed once, and the queries pass by it in a stream. So a row is
moved once however many queries there are, and a query once for each tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import cosines, matrix, rotation, unit_rows, usable

#: Sorted arrays that are counted at once.
CHUNK = 16


class Tile:
    """The sorted arrays of some rows. uid tells rows apart, ids name them. sure: the probability with which a row within
    the radius reaches the collision threshold."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bases: int, reach: float, sure: float, growth: float, sample: int = 32) -> None:
        self.uid, self.ids, self.x, self.k, self.reach = uid, ids, x, k, reach
        n, d = x.shape
        self.unit = unit_rows(x)
        self.turn = np.concatenate([rotation(d, seed=11 + b) for b in range(bases)], axis=1)
        m = self.turn.shape[1]
        kind = np.uint16 if n < 1 << 16 else np.uint32
        self.values, self.rank = np.empty((m, n)), np.empty((m, n), kind)
        for j in range(m):
            value = self.unit @ self.turn[:, j]
            order = np.argsort(value, kind="stable")
            self.values[j] = value[order]
            self.rank[j, order] = np.arange(n, dtype=kind)
        share = 2 * NormalDist().cdf(reach) - 1
        self.need = int(np.ceil(m * share - NormalDist().inv_cdf(sure) * np.sqrt(m * share * (1 - share))))
        if n > k:
            near = np.partition(self.unit[:: max(1, n // sample)][:sample] @ self.unit.T, n - 1 - k, axis=1)[:, n - 1 - k]
            first = float(np.sqrt(np.maximum(2 - 2 * np.median(near), 0.01)))
            self.levels = [first * growth**i for i in range(int(np.ceil(np.log(2 / first) / np.log(growth))) if first < 2 else 0)]
        else:
            self.levels = []

    def windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) ranks of the window in each array, for each query."""
        w = self.reach * radius / np.sqrt(self.x.shape[1])
        ends = [(np.searchsorted(v, a - w, "left"), np.searchsorted(v, a + w, "right")) for v, a in zip(self.values, at.T, strict=True)]
        return np.stack([e[0] for e in ends], axis=1), np.stack([e[1] for e in ends], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many windows of one query each row lies."""
        n, kind = len(self.uid), self.rank.dtype
        hits = np.zeros(n, np.uint16)
        # windows of all ranks would be one too wide for the type
        width = high - low
        hits += np.uint16((width >= n).sum())
        some = np.flatnonzero(width < n)
        for s in range(0, len(some), CHUNK):
            j = some[s : s + CHUNK]
            gap = self.rank[j]
            gap -= low[j].astype(kind)[:, None]  # ranks below the window wrap round
            hits += np.add.reduce((gap < width[j].astype(kind)[:, None]).view(np.uint8), axis=0, dtype=np.uint8)
        return hits

    def search(self, uid: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place of the query, rows, cosines): the k nearest rows to each query, itself left out, nearest first; equal
        cosines go by id."""
        n, k = len(self.uid), self.k
        unit = unit_rows(q)
        at = unit @ self.turn
        tested = [np.zeros(n, bool) for _ in uid]
        kept: list[np.ndarray] = [np.empty(0, np.int64) for _ in uid]
        scores: list[np.ndarray] = [np.empty(0) for _ in uid]
        open_ = list(range(len(uid)))
        for c in open_:
            tested[c][self.uid == uid[c]] = True
        for radius in self.levels:
            if not open_:
                break
            low, high = self.windows(at[open_], radius)
            left = []
            for c, lo, hi in zip(open_, low, high, strict=True):
                new = np.flatnonzero((self.collisions(lo, hi) >= self.need) & ~tested[c])
                tested[c][new] = True
                kept[c], scores[c] = np.concatenate([kept[c], new]), np.concatenate([scores[c], self.unit[new] @ unit[c]])
                if len(kept[c]) < k or 2 - 2 * np.partition(scores[c], len(kept[c]) - k)[-k] > radius * radius:
                    left.append(c)
            open_ = left
        for c in open_:
            new = np.flatnonzero(~tested[c])
            kept[c], scores[c] = np.concatenate([kept[c], new]), np.concatenate([scores[c], self.unit[new] @ unit[c]])
        for c, (rows, score) in enumerate(zip(kept, scores, strict=True)):
            if len(rows) > k:
                # a margin for rounding; what is within it is told apart by the exact cosine
                rows = rows[score >= np.partition(score, len(score) - k)[-k] - 1e-9]
            exact = cosines(self.x[rows], np.broadcast_to(q[c], (len(rows), q.shape[1])))
            best = np.lexsort((self.ids[rows], -exact))[:k]
            yield c, rows[best], exact[best]


def _pieces(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches in pieces of at most step rows with one (d, i, asks)."""
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "i", "asks")], axis=1)
        ends = np.append(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(marks)) if len(marks) else []
        begin = 0
        for end in ends:
            for s in range(begin, end, step):
                yield tuple(marks[begin]), batch.slice(s, min(step, end - s))
            begin = end


def nearest(
    df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, tile: int = 32768, least_tile: int = 4096, bases: int = 2,
    reach: float = 1.4, sure: float = 0.9, growth: float = 1.05, step: int = 256,
) -> DataFrame:
    """The k nearest rows to each query by cosine.

    Queries are the rows that is_query, a Column over key (named id), holds for; every row but the query's own is a
    candidate. Returns query_id, rank (int, from 1), key and score, the exact cosine in double precision; equal scores go
    to the smaller key. Fewer than k candidates give fewer rows. bases: how many orthogonal sets of projections; sure:
    the probability with which a row within the radius reaches the collision threshold.

    Rows are dealt at random to tiles of about `tile` rows, or of least_tile and more where that makes no more tiles than
    shuffle partitions. A task holds a tile, with 2 * bases + 2 numbers for each of a vector's, and `step` queries; each
    gives k rows. Vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do rows with a
    null key; vectors are compared with those of their own length. Rows with the same key are rows of their own: each is
    a candidate for the others, and as queries each gets its ranks. An empty table gives an empty result. Other columns
    aren't read.
    """
    spark = df.sparkSession
    found = cut(usable(df, key, vector).withColumns({"_q": F.coalesce(is_query, F.lit(False)), "uid": F.monotonically_increasing_id()}))
    n = found.count()
    tiles = max(1, -(-n // tile), min(-(-n // least_tile), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = found.select("uid", "id", "d", "vec", F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int").alias("i"), F.lit(False).alias("asks"))
    asked = found.where("_q").select("uid", "id", "d", "vec", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("i"), F.lit(True).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gathered, made = None, [], None
        for (d, i, asks), piece in _pieces(batches, step):
            if (d, i) != own:
                own, gathered, made = (d, i), [], None
            if not asks:
                gathered.append(piece.select(["uid", "id", "vec"]))
                continue
            if made is None and gathered:
                all_ = pa.Table.from_batches(gathered)
                made, gathered = Tile(all_["uid"].to_numpy(), all_["id"].to_numpy(), matrix(all_["vec"]), k, bases, reach, sure, growth), []
            if made is not None:
                uid, ids = piece.column("uid").to_numpy(), piece.column("id").to_numpy()
                got = list(made.search(uid, matrix(piece.column("vec"))))
                at = np.repeat([c for c, _, _ in got], [len(r) for _, r, _ in got]).astype(np.int64)
                near = np.concatenate([r for _, r, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(ids[at]), pa.array(made.ids[near]), pa.array(np.concatenate([s for *_, s in got]))], ["uid", "query_id", "id", "score"])

    # one tile a partition; in it the rows come before the queries
    dealt = rows.unionByName(asked).repartitionById(tiles, F.col("i")).sortWithinPartitions("d", "i", "asks")
    near = dealt.mapInArrow(run, "uid bigint, query_id bigint, id bigint, score double")
    order = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("id"))
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
