"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. A random rotation spreads that distance over the
coordinates, which are split into m blocks with a share of the budget in proportion to their width. If a pair is
within the budget as a whole, it is within the share of one block at least. So a range join in each block finds every
pair; the union of what they find is verified on the original vectors in double precision.

The range join of a block cuts the first coordinate of the block into slabs at least as wide as its radius. A vector is
at home in its slab and visits the next one if it is within the radius of it. Slabs have at most 2 / width + 1 numbers,
so their counts come to the driver; a slab with more than `tile` vectors is dealt into tiles, and every pair of tiles
is a task of its own. So no task holds more than two tiles, however many vectors are alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components
from .vectors import PLAIN, cosines, matrix, rotation, unit_rows, usable

#: Added to the block budgets: more than the rounding of single-precision coordinates, so that no pair is missed.
SLACK = 1e-5


def block_edges(d: int, width: int) -> list[int]:
    """Where the blocks begin and end: about d / width blocks whose widths differ by one at most."""
    m = max(1, round(d / width))
    return [d * k // m for k in range(m + 1)]


def budgets(d: int, width: int, threshold: float) -> list[float]:
    """The squared distance that each block may have."""
    e = block_edges(d, width)
    return [(2 - 2 * threshold) * (b - a) / d + SLACK for a, b in zip(e, e[1:])]


def first_block(a: np.ndarray, b: np.ndarray, edges: list[int], limits: list[float]) -> np.ndarray:
    """The first block in which the rows of a and b are within the limit; len(limits) where there is none."""
    gap = (a.astype(np.float64) - b) ** 2
    near = np.stack([gap[:, s:e].sum(axis=1) <= x for s, e, x in zip(edges, edges[1:], limits)] + [np.ones(len(a), bool)], axis=1)
    return near.argmax(axis=1)


def local_roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after the links i-j are added to a forest whose labels are the smallest members."""
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _close(own: np.ndarray, side: np.ndarray, limit: float, step: int = 2048, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a unit's rows whose squared distance in the block is within the limit, at most `most` at once. side:
    1 in a tile with itself, else 0 and 2 for the two tiles."""
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    same = bool((side == 1).all())
    square, one = np.einsum("ij,ij->i", own, own)[:, None], np.ones((len(own), 1), own.dtype)
    # |x - y|^2 as one product
    x, y = np.concatenate([-2 * own, square, one], axis=1), np.concatenate([own, one, square], axis=1)
    for s in range(0, len(left), step):
        a = left[s : s + step]
        for t in range(s if same else 0, len(right), step):
            b = right[t : t + step]
            hit = np.flatnonzero((x[a] @ y[b].T <= limit + SLACK).ravel())
            for c in range(0, len(hit), most):
                i, j = np.divmod(hit[c : c + most], len(b))
                i, j = a[i], b[j]
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j


UNIT = "d int, k int, slab int, visit int, i int, j int"


def _which(threshold: float, width: int):
    """First pass: of each unit, the vectors that have a pair within the block's budget."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        d, k = key[0].as_py(), key[1].as_py()
        uid, side = rows["uid"].to_numpy(), rows["side"].to_numpy()
        own = rows["own"].combine_chunks().flatten().to_numpy().reshape(len(uid), -1)
        hit = np.zeros(len(uid), bool)
        for i, j in _close(own, side, budgets(d, width, threshold)[k]):
            hit[i] = hit[j] = True
        at = np.flatnonzero(hit)
        unit = [pa.array(np.full(len(at), v.as_py()), pa.int32()) for v in key]
        return pa.Table.from_arrays([*unit, pa.array(uid[at], pa.int64()), pa.array(side[at], pa.int32())], ["d", "k", "slab", "visit", "i", "j", "uid", "side"])

    return run


def _verify(threshold: float, width: int):
    """Second pass: links and roots of those, by the original vectors."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        k = key[1].as_py()
        ids, n_copies = rows["uid"].to_numpy(), rows["n"].to_numpy()
        side, x = rows["side"].to_numpy(), matrix(rows["vec"])
        turned = np.frombuffer(b"".join(rows["turned"].to_pylist()), np.float32).reshape(x.shape)
        edges, limits = block_edges(x.shape[1], width), budgets(x.shape[1], width, threshold)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in _close(turned[:, edges[k] : edges[k + 1]], side, limits[k], most=1 << 14):
            # a pair counts in the first block that finds it; all tasks agree on that
            mine = first_block(turned[i], turned[j], edges, limits) == k
            i, j = i[mine], j[mine]
            mine = cosines(x[i], x[j]) >= threshold
            i, j = i[mine], j[mine]
            if len(i):
                np.add.at(links, i, n_copies[j])
                np.add.at(links, j, n_copies[i])
                label = local_roots(len(ids), i, j, label)
        hit = np.flatnonzero(links)
        return pa.table({"uid": ids[hit], "links": links[hit], "root": ids[label[hit]]})

    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, width: int = 16, tile: int = 16384) -> DataFrame:
    """Links between all vectors whose cosine is at least threshold.

    Returns a row for each row of df: key, n_links (other rows linked directly), component_id (the smallest key
    reachable by links, itself included) and kept (key = component_id). Equal vectors are compared once and counted
    by their number. Vectors of different lengths, and vectors that are null, empty, zero, or hold null or non-finite
    numbers, link with nothing; a row with such a vector has n_links 0 and itself as component. So has a row with a
    null key, whose component_id is null and kept false. Rows with the same key are vectors of their own. Other
    columns aren't read. An empty table gives an empty result. Memory: two tiles in a task, besides some 100 MB for the
    pairs that are looked at.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            turned: list[bytes] = [b""] * len(vecs)
            for d in set(batch.column(1).to_pylist()):
                at = [i for i, v in enumerate(vecs) if len(v) == d * np.dtype(PLAIN).itemsize]
                x = unit_rows(np.frombuffer(b"".join(vecs[i] for i in at), PLAIN).reshape(-1, d)) @ rotation(d)
                for i, v in zip(at, x.astype(np.float32), strict=True):
                    turned[i] = v.tobytes()
            same = [hashlib.blake2b(v, digest_size=16).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turned, pa.binary()), pa.array(same, pa.binary())], ["id", "d", "vec", "turned", "same"])

    found = cut(usable(df, key, vector).mapInArrow(turn, "id bigint, d int, vec binary, turned binary, same binary"))
    single = found.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("d").alias("d"), F.first("vec").alias("vec"), F.first("turned").alias("turned"))
    single = cut(single.withColumn("uid", F.monotonically_increasing_id()))

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector, block and slab, at home (0) or on a visit (1), with the vector's part in the block."""
        for batch in batches:
            uid, ds = batch.column("uid").to_numpy(), batch.column("d").to_numpy()
            vecs = batch.column("turned").to_pylist()
            for d in np.unique(ds).tolist():
                at = np.flatnonzero(ds == d)
                x = np.frombuffer(b"".join(vecs[i] for i in at), np.float32).reshape(-1, d)
                edges = block_edges(d, width)
                for k, limit in enumerate(budgets(d, width, threshold)):
                    slab = np.floor(x[:, edges[k]] / (np.sqrt(limit) + SLACK)).astype(np.int32)
                    own = np.ascontiguousarray(x[:, edges[k] : edges[k + 1]])
                    own = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
                    for visit in (0, 1):
                        fixed = [pa.array(np.full(len(at), v, np.int32)) for v in (d, k, visit)]
                        yield pa.RecordBatch.from_arrays([pa.array(uid[at]), fixed[0], fixed[1], pa.array(slab + np.int32(visit)), fixed[2], own], ["uid", "d", "k", "slab", "visit", "own"])

    placed = cut(single.select("uid", "d", "turned").mapInArrow(slabs, "uid bigint, d int, k int, slab int, visit int, own array<float>").withColumn("_h", F.xxhash64("uid")))
    counts = placed.groupBy("d", "k", "slab", "visit").count().groupBy("d", "k", "slab").pivot("visit", [0, 1]).agg(F.first("count"))
    counts = counts.select("d", "k", "slab", *[F.ceil(F.coalesce(F.col(str(v)), F.lit(0)) / tile).cast("int").alias(f"t{v}") for v in (0, 1)]).where("t0 > 0")
    # tiles of vectors at home: i; of visitors: j. A tile at home meets itself, the tiles after it and all visitors.
    tiled = placed.join(F.broadcast(counts), ["d", "k", "slab"])
    home = F.pmod(F.col("_h"), F.col("t0")).cast("int")
    guest = F.pmod(F.col("_h"), F.greatest("t1", F.lit(1))).cast("int")
    numbers = F.sequence(F.lit(0), F.col("t0") - 1)
    among = F.transform(numbers, lambda o: F.struct(F.least(o, home).alias("i"), F.greatest(o, home).alias("j"), F.when(o == home, 1).when(home < o, 0).otherwise(2).alias("side"), F.lit(0).alias("visit")))
    hosts = F.transform(F.when(F.col("t1") > 0, F.sequence(F.lit(0), F.col("t1") - 1)).otherwise(F.array().cast("array<int>")), lambda o: F.struct(home.alias("i"), o.alias("j"), F.lit(0).alias("side"), F.lit(1).alias("visit")))
    visits = F.transform(numbers, lambda o: F.struct(o.alias("i"), guest.alias("j"), F.lit(2).alias("side"), F.lit(1).alias("visit")))
    dealt = tiled.select("uid", "own", "d", "k", "slab", F.explode(F.when(F.col("visit") == 0, F.concat(among, hosts)).otherwise(visits)).alias("_t"))
    dealt = dealt.select("uid", "own", "d", "k", "slab", F.col("_t.i").alias("i"), F.col("_t.j").alias("j"), F.col("_t.visit").alias("visit"), F.col("_t.side").alias("side"))
    unit = ["d", "k", "slab", "visit", "i", "j"]
    work = cut(dealt.groupBy(*unit).applyInArrow(_which(threshold, width), f"{UNIT}, uid bigint, side int"))
    # whole vectors go only to the units where they have a pair to verify
    full = work.join(single.select("uid", "n", "vec", "turned"), "uid")
    hits = cut(full.groupBy(*unit).applyInArrow(_verify(threshold, width), "uid bigint, links bigint, root bigint"))

    links = hits.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(hits.where("uid <> root"), "uid", "root")
    placed_in = single.select("uid", "same", "id", "n").join(roots, F.col("uid") == F.col("node"), "left")
    placed_in = placed_in.select("uid", "same", "id", "n", F.coalesce("root", "uid").alias("root"))
    low = placed_in.groupBy("root").agg(F.min("id").alias("component_id"))
    reps = placed_in.join(low, "root").join(links, "uid", "left")
    reps = reps.select("same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
    known = found.select("id", "same").join(reps, "same").select(F.col("id").alias("_k"), "n_links", "component_id")
    rest = df.select(F.col(key).alias(key)).where(F.col(key).isNull()).unionByName(_unusable(df, key, vector))
    lone = rest.select(key, F.lit(0).cast("bigint").alias("n_links"), F.col(key).cast("bigint").alias("component_id"))
    out = known.select(F.col("_k").alias(key), "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def _unusable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Keys, not null, of the rows that usable() leaves out."""
    v = F.col(vector)
    sound = F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return df.where(F.col(key).isNotNull() & ~sound).select(F.col(key).alias(key))
