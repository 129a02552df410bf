"""N-gram Jaccard join: MinHash banding, pairs verified on full n-gram sets.

Documents with equal sets of shingles are one class. Classes are dealt to buckets by the hash of each band; a bucket
holds those that agree in a band. A pair of classes belongs to the first band in which it agrees, so it is looked at
once. Buckets go through two passes: the first looks at band numbers alone and keeps the classes that have a pair to
verify; only these get their texts, from which the second pass makes the full sets again. A bucket with many classes,
or with long ones, is dealt into tiles, and each pair of tiles is a unit of its own. Both passes return a row for each
class and unit, never a row for each pair: how many documents it is linked with, and the root of a forest over its links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, identity, small_batches
from .graph import components
from .near_vectors import local_roots
from .shingles import WORDS, band_codes, choose_bands, shingle_set

#: Holds of a text with a word.
ANY_WORD = WORD.removesuffix("+")
#: Classes in a tile. Smaller tiles make more units of a hot bucket, which spread more evenly, and move each text more often.
TILE = 256


def set_name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def new_pairs(codes: np.ndarray, band: int, side: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, in blocks, of a unit's rows that agree in this band and in none before it. side: 1 in a tile with
    itself, else 0 and 2 for the two tiles."""
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    same = bool((side == 1).all())
    for s in range(0, len(left), step):
        a = left[s : s + step]
        for t in range(s if same else 0, len(right), step):
            b = right[t : t + step]
            new = codes[a, band][:, None] == codes[b, band]
            for k in range(band):
                new &= codes[a, k][:, None] != codes[b, k]
            i, j = np.nonzero(new)
            i, j = a[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many shingles the sets i and j share, pair by pair."""
    members = np.unique(np.concatenate([i, j]))
    if len(i) <= 8 * len(members):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    # many pairs among few sets: count by matrix products over the shingles that two sets or more hold
    size = np.array([len(sets[m]) for m in members])
    owner = np.repeat(np.arange(len(members)), size)
    found, at, count = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[at] > 1
    owner, at = owner[shared], number[at[shared]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(members), len(members)), np.float32)
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        lo, hi = np.searchsorted(at, [c, c + columns])
        part = np.zeros((len(members), columns), np.float32)
        part[owner[lo:hi], at[lo:hi] - c] = 1
        total += part @ part.T
    return total[np.searchsorted(members, i), np.searchsorted(members, j)].astype(np.int64)


def _which(band_count: int):
    """First pass: of each unit, the classes that have a pair to verify."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("rows")
            ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
            flat = rows.flatten()
            uid, side = flat.field("uid").to_numpy(), flat.field("side").to_numpy()
            codes = flat.field("codes").flatten().to_numpy().reshape(len(uid), band_count)
            bands = batch.column("band").to_pylist()
            unit, who = [], []
            for u, (end, band) in enumerate(zip(ends, bands, strict=True)):
                begin = ends[u - 1] if u else 0
                hit = np.zeros(end - begin, bool)
                for i, j in new_pairs(codes[begin:end], band, side[begin:end]):
                    hit[i] = hit[j] = True
                at = np.flatnonzero(hit) + begin
                unit.append(np.full(len(at), u))
                who.append(at)
            unit, who = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (unit, who))
            taken = [batch.column(c).take(pa.array(unit)) for c in ("band", "code", "i", "j")]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(uid[who], pa.int64()), pa.array(side[who], pa.int32())], ["band", "code", "i", "j", "uid", "side"])

    return run


def _verify(threshold: float, words: int, band_count: int):
    """Second pass: of each unit, links and roots of the classes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        band = key[0].as_py()
        uid, side, n_copies = (rows[c].to_numpy() for c in ("uid", "side", "n"))
        codes = rows["codes"].combine_chunks().flatten().to_numpy().reshape(len(uid), band_count)
        sets = [shingle_set(t, words) for t in rows["text"].to_pylist()]
        size = np.array([len(s) for s in sets])
        links, label = np.zeros(len(uid), np.int64), np.arange(len(uid))
        for i, j in new_pairs(codes, band, side):
            # sizes alone rule some pairs out
            able = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[able], j[able]
            if not len(i):
                continue
            both = intersections(sets, i, j)
            near = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[near], j[near]
            if len(i):
                np.add.at(links, i, n_copies[j])
                np.add.at(links, j, n_copies[i])
                label = local_roots(len(uid), i, j, label)
        hit = np.flatnonzero(links)
        return pa.table({"uid": uid[hit], "links": links[hit], "root": uid[label[hit]]})

    return run


class _Found(NamedTuple):
    """rows: id, name (of the row's set; null without words), _i and _j (the row's identity). classes: uid, name, id (the
    smallest), n, root, links. lowest: root and first, the identity of its first row: that with the smallest key, nulls
    last, then the smallest hashes."""

    rows: DataFrame
    classes: DataFrame
    lowest: DataFrame


def _find(plain: DataFrame, threshold: float, words: int, recall: float, tile: int, tile_shingles: int) -> _Found:
    """plain: id, text, _i and _j. Rows that agree in _i and _j are equal in id and text."""
    bands, rows = choose_bands(threshold, recall)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(3).to_pylist()]
            codes = [band_codes(s, bands, rows) if len(s) else None for s in sets]
            names = [set_name(s) if len(s) else None for s in sets]
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(codes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["id", "_i", "_j", "size", "name", "codes"])

    described = cut(small_batches(plain).select("id", "_i", "_j", "text").mapInArrow(describe, "id bigint, _i bigint, _j bigint, size bigint, name binary, codes array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_i", "_j"))
    classes = described.where("name is not null").groupBy("name").agg(first.alias("first"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("codes").alias("codes"))
    classes = cut(classes.withColumns({"uid": F.monotonically_increasing_id(), "id": F.col("first.id")}))

    agreed = classes.select("uid", "size", F.posexplode("codes").alias("band", "code"))
    tiles = F.greatest(F.ceil(F.count("*") / F.lit(tile)), F.ceil(F.sum("size") / F.lit(tile_shingles)))
    buckets = agreed.groupBy("band", "code").agg(F.count("*").alias("_c"), F.least(tiles, F.count("*")).cast("int").alias("t")).where("_c > 1").drop("_c")
    buckets = cut(buckets)  # so that Spark can split the join at a hot bucket; it can't above an aggregation
    home = F.pmod(F.xxhash64("uid"), F.col("t")).cast("int")
    dealt = agreed.join(buckets, ["band", "code"]).select("uid", "band", "code", home.alias("_h"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("_o"))
    side = F.when(F.col("_o") == F.col("_h"), 1).when(F.col("_h") < F.col("_o"), 0).otherwise(2)
    dealt = dealt.select("uid", "band", "code", F.least("_h", "_o").alias("i"), F.greatest("_h", "_o").alias("j"), side.alias("side"))
    units = dealt.join(classes.select("uid", "codes"), "uid").groupBy("band", "code", "i", "j").agg(F.collect_list(F.struct("uid", "side", "codes")).alias("rows"))
    # a unit is at most two tiles, so its list is bounded
    work = cut(units.where(F.size("rows") > 1).mapInArrow(_which(bands), "band int, code bigint, i int, j int, uid bigint, side int"))

    # a class is verified on the text of its first row, or of one that equals it
    wanted = work.select("uid").distinct().join(classes, "uid").select("uid", "n", "codes", F.col("first._i").alias("_i"), F.col("first._j").alias("_j"))
    texts = plain.select("_i", "_j", "text").join(wanted, ["_i", "_j"]).select("uid", "n", "codes", "text")
    texts = texts.dropDuplicates(["uid"]) if _repeats(described) else texts
    full = work.join(texts, "uid")
    hits = cut(full.groupBy("band", "code", "i", "j").applyInArrow(_verify(threshold, words, bands), "uid bigint, links bigint, root bigint"))

    links = hits.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(hits.where("uid <> root"), "uid", "root")
    placed = classes.select("uid", "name", "id", "first", "n").join(roots, F.col("uid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "uid")).drop("node")
    lowest = placed.groupBy("root").agg(F.min("first").alias("first"))
    return _Found(described.select("id", "name", "_i", "_j"), placed.drop("first").join(links, "uid", "left"), lowest)


def near_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = WORDS, recall: float = 0.9999, tile: int = TILE, tile_shingles: int = 1_000_000
) -> DataFrame:
    """Links between all documents whose sets of word shingles have a Jaccard similarity of threshold or more.

    Returns a row for each row of docs: key, class_id (the smallest key among documents with the same set), n_links
    (other rows linked directly, those of the same class included), component_id (the smallest key reachable by
    links, itself included) and kept (key = component_id). Words are maximal runs of anything but space, tab and
    line ends, in lower case. A pair of different sets at the threshold is found with probability recall, one
    above it with more; what is found is verified exactly, and whole texts count.

    A text of fewer words than a shingle is one shingle. A null text, or one without words, links with nothing and is
    a class and a component of its own. Rows with the same key are documents of their own; a null key takes no part
    in minima, and its row has a null component where it is alone. Other columns aren't read. An empty table gives an
    empty result. Memory: two tiles of `tile` texts, or of about tile_shingles shingles, in a task; a text longer than
    that is in a tile alone or with few others.
    """
    plain = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    marks = identity(plain)
    found = _find(plain.withColumns({"_i": marks[0], "_j": marks[1]}), threshold, words, recall, tile, tile_shingles)
    low = found.lowest.select("root", F.col("first.id").alias("component_id"))
    known = found.classes.join(low, "root").select("name", F.col("id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), "component_id")
    out = found.rows.where("name is not null").join(known, "name").select("id", "class_id", "n_links", "component_id")
    alone = found.rows.where("name is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select(F.col("id").alias(key), "class_id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _repeats(described: DataFrame) -> bool:
    """Whether a row stands in the table more than once."""
    return not described.groupBy("_i", "_j").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, words: int = WORDS, recall: float = 0.9999) -> DataFrame:
    """The documents, all columns, one row of each group of near copies: that with the smallest key, nulls last; of rows
    with that key the one whose hashes over all columns are smallest, so reruns agree.

    Rows count, not keys: rows that share a key, or have none, stay or go by their own texts. A row whose text is null or
    holds no words links with nothing and stays. An empty table gives an empty result.
    """
    i, j, seen = (fresh(n, docs.columns) for n in ("_i", "_j", "_seen"))
    marks = identity(docs)
    plain = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), marks[0].alias("_i"), marks[1].alias("_j"))
    found = _find(plain, threshold, words, recall, TILE, 1_000_000)
    marked = docs.withColumns({i: marks[0], j: marks[1]})
    first = cut(found.lowest.select(F.col("first._i").alias(i), F.col("first._j").alias(j), F.lit(True).alias(seen)))
    worded = F.coalesce(F.col(text).cast("string").rlike(ANY_WORD), F.lit(False))
    if _repeats(found.rows.where("name is not null")):
        # of equal rows one; they are joined in each task before they are dealt
        marked = marked.where(worded).dropDuplicates([i, j]).unionByName(marked.where(~worded))
    out = marked.join(first, [i, j], "left").where(F.col(seen) | ~worded)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
