"""Line dedup: a log-template tree.

Lines are parsed by a tree of fixed depth: the number of tokens, then the leading tokens, with tokens that hold a digit
as variable fields. In a leaf, lines are linked that agree in enough of their tokens, fields aside; lines that are
linked, directly or by others, share a template. Every line of the leaf takes part, one that recurs verbatim too, and
votes with its count. A template whose lines stand in enough documents recurs: its lines are dropped from all documents
but the first.

Counts by line and leaf are summed before the shuffle, so a line that is in a third of all documents is a few rows for
each task. Tokens are looked at only for lines in leaves that hold several lines and could recur, once for each line.

Not all lines of a leaf are compared. Lines that may differ in m places have m + 1 stretches, and two that are linked agree
in one stretch at least; so a line gets a key for each stretch, and only lines that share a key meet. Where m is 1, a key is
a line without one of its places: then lines that share one are linked for certain, and each is linked with the smallest.
The lines of a leaf that share keys are one unit of work if they are at most a tile; else units are made of keys. A key
with more lines than a tile first compares all of them with one, and only what that leaves is dealt into tiles
against the rest. All links are found; versions of one line cost in proportion to their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches
from .graph import components

FIELD = "<*>"
#: Characters from which on a line of fewer tokens than count as a line is one all the same, and a long one.
SOME, MANY = 20, 100
_TOKEN = re.compile("[^\x20\x09-\x0d]+")
_DIGIT = re.compile(r"\d")


def code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


#: The code of a field among those of tokens.
FIELD_CODE = code(FIELD)


def tokens(line: str) -> list[str]:
    """The line's tokens; those that hold a digit are fields."""
    found = _TOKEN.findall(line)
    return [FIELD if _DIGIT.search(t) else t for t in found] if _DIGIT.search(line) else found


def parse(line: str, depth: int, least: int, similarity: float, long: int) -> tuple[int, int, int, bool] | None:
    """(tokens, leaf, line, fixed) of a line: its number of tokens, and the codes of its leaf and of itself. fixed: enough of
    its tokens aren't fields. The code of a line is that of its tokens with fields masked if it is fixed, as they stand if
    not. A line of fewer tokens than `least` isn't fixed, and counts as `least` or `long` tokens if it has the characters.
    None for a line without tokens."""
    t = tokens(line)
    if len(t) < least:
        as_is = " ".join(_TOKEN.findall(line))
        n = long if len(as_is) >= MANY else least if len(as_is) >= SOME else len(t)
        return (n, code(str(len(t))), code(as_is), False) if t else None
    fixed = t.count(FIELD) <= (1 - similarity) * len(t)
    return len(t), code(" ".join([str(len(t)), *t[:depth]])), code(" ".join(t if fixed else _TOKEN.findall(line))), fixed


def signatures(codes: list[int], depth: int, similarity: float) -> tuple[bool, list[int]]:
    """(sure, keys) of a line by the codes of its tokens. Linked lines of a leaf share a key; if sure, those that share one
    are linked. A line that can be linked with no other has no keys."""
    rest = codes[depth:]
    spare = int(len(codes) * (1 - similarity) + 1e-9) - codes[:depth].count(FIELD_CODE)
    fields = [p for p, c in enumerate(rest) if c == FIELD_CODE]
    if spare < 1 or len(fields) > spare:
        return True, []
    if spare >= len(rest):
        return True, [0]
    b = np.array(rest, np.int64).tobytes()
    if spare == 1:
        parts = [(p, b[: 8 * p] + b[8 * p + 8 :]) for p in fields or range(len(rest))]
    else:
        cuts = [len(rest) * k // (spare + 1) for k in range(spare + 2)]
        parts = [(k, b[8 * s : 8 * e]) for k, (s, e) in enumerate(zip(cuts, cuts[1:])) if not any(s <= p < e for p in fields)]
    return spare == 1, [xxhash.xxh3_64_intdigest(part, seed=k) - (1 << 63) for k, part in parts]


def linked(line: np.ndarray, x: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the lines linked with another, directly or by others of these, each with one that stands for all of them. x:
    the codes of their tokens."""
    field = x == FIELD_CODE
    one, other = np.where(field, 0, x), np.where(field, 1, x)  # a field agrees with nothing
    need = similarity * x.shape[1] - 1e-9
    root, left = np.arange(len(line)), np.arange(len(line))
    while len(left):
        first, left, other = left[0], left[1:], other[1:]
        open_ = [first]
        while open_ and len(left):
            hit = np.count_nonzero(other == one[open_.pop()], axis=1) >= need
            if hit.any():
                root[left[hit]] = first
                open_ += left[hit].tolist()
                left, other = left[~hit], other[~hit]
    at = np.flatnonzero(root != np.arange(len(line)))
    return line[at], line[root[at]]


def _linked(similarity: float):
    """The same for a unit of (line, tokens), or, with a column key, for each key of the unit."""

    def run(rows: pa.Table) -> pa.Table:
        line = rows["line"].to_numpy()
        x = rows["tokens"].combine_chunks().flatten().to_numpy().reshape(len(line), -1)
        if "key" not in rows.column_names:
            a, b = linked(line, x, similarity)
            return pa.table({"a": a, "b": b})
        key = rows["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(order))
        found = [linked(line[at], x[at], similarity) for at in np.split(order, ends[:-1])]
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    return run


def _tiles(count: Column, n: Column, tile: int, tile_tokens: int) -> Column:
    """How many tiles so many lines of n tokens make."""
    return F.least(F.greatest(F.ceil(count / F.lit(tile)), F.ceil(count * n / F.lit(tile_tokens))), count).cast("int")


def links(placed: DataFrame, similarity: float, tile: int, tile_tokens: int) -> DataFrame:
    """(a, b): a forest over the linked lines of placed(leaf, line, n, tokens, sure, keys)."""
    keyed = placed.select("leaf", "line", "n", "sure", F.explode("keys").alias("key"))
    shared = cut(keyed.groupBy("leaf", "key", "sure").agg(F.count("*").alias("_c"), F.min("line").alias("_low")).where("_c > 1"))
    met = keyed.join(shared, ["leaf", "key", "sure"])
    edges = "a bigint, b bigint"
    out = met.where("sure and line <> _low").select(F.col("line").alias("a"), F.col("_low").alias("b"))
    met = cut(met.where("not sure").select("leaf", "line", "n", "key", "_c", "_low"))
    lines = met.select("leaf", "line", "n").distinct()
    sizes = cut(lines.groupBy("leaf").agg(F.count("*").alias("_l"), F.first("n").alias("_n")).withColumn("t", _tiles(F.col("_l"), F.col("_n"), tile, tile_tokens)).select("leaf", "t"))
    tokens_of = placed.select("line", "tokens")
    small = lines.join(sizes.where("t = 1"), "leaf").join(tokens_of, "line").select("leaf", "line", "tokens")
    out = out.unionByName(small.groupBy("leaf").applyInArrow(_linked(similarity), edges))
    large = sizes.where("t > 1")
    if large.isEmpty():
        return out
    met = met.join(large.select("leaf"), "leaf").withColumn("t", _tiles(F.col("_c"), F.col("n"), tile, tile_tokens))
    # keys of at most a tile, several to a unit of about a tile
    single = met.where("t = 1")
    parts = cut(single.groupBy("leaf").agg(F.count("*").alias("_m"), F.first("n").alias("_n")).select("leaf", _tiles(F.col("_m"), F.col("_n"), tile, tile_tokens).alias("_p")))
    dealt = single.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("key"), F.col("_p"))).join(tokens_of, "line")
    out = out.unionByName(dealt.select("leaf", "part", "key", "line", "tokens").groupBy("leaf", "part").applyInArrow(_linked(similarity), edges))
    # larger keys: all lines against the smallest first
    hot = met.where("t > 1").join(tokens_of, "line").join(tokens_of.select(F.col("line").alias("_low"), F.col("tokens").alias("_first")), "_low")
    agree = F.size(F.filter(F.zip_with("tokens", "_first", lambda x, y: (x == y) & (x != FIELD_CODE)), lambda same: same))
    hot = cut(hot.select("leaf", "key", "line", "tokens", "t", "_low", (agree >= F.col("n") * F.lit(similarity) - 1e-9).alias("near")))
    out = out.unionByName(hot.where("near and line <> _low").select(F.col("line").alias("a"), F.col("_low").alias("b")))
    left = hot.where("not near").groupBy("leaf", "key").agg(F.count("*").alias("_r"), F.first(F.size("tokens")).alias("_n"))
    left = cut(left.select("leaf", "key", _tiles(F.col("_r"), F.col("_n"), tile, tile_tokens).alias("_q")))
    both = hot.join(left, ["leaf", "key"])
    spread = lambda tiles: F.explode(F.sequence(F.lit(0), tiles - 1))
    home = lambda tiles: F.pmod(F.xxhash64("line"), tiles).cast("int")
    some = both.where("not near").select("leaf", "key", "line", "tokens", home(F.col("_q")).alias("i"), spread(F.col("t")).alias("j"))
    every = both.select("leaf", "key", "line", "tokens", spread(F.col("_q")).alias("i"), home(F.col("t")).alias("j"))
    # a line that is on both sides of a unit is linked with itself, which does no harm
    units = some.unionByName(every).groupBy("leaf", "key", "i", "j")
    return out.unionByName(units.applyInArrow(lambda rows: _linked(similarity)(rows.drop_columns(["key"])), edges))


def drop_recurring_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 3, depth: int = 3, least: int = 3, least_variable: int = 5, similarity: float = 0.8,
    long_docs: int = 2, long: int = 20, short_docs: int = 10, tile: int = 512, tile_tokens: int = 250_000,
) -> DataFrame:
    """The documents, all columns, without recurring lines, and with the columns n_lines and n_dropped (bigint).

    A line of at least `least` tokens recurs if it stands in min_docs rows of docs or more, one of at least `long` tokens in
    long_docs, one of fewer than `least` in short_docs (in min_docs from SOME characters on, in long_docs from MANY): token
    for token, or, if at least
    `similarity` of its tokens are no fields, with any tokens for fields. Of the latter lines, one of at least least_variable tokens also recurs if its template does: if it and the lines linked with it stand in as many
    different rows.
    Two lines are linked if they have the same number of tokens and the same first `depth`, and agree in at least
    `similarity` of all, place by place; fields agree with nothing. A recurring line stays in the row with the smallest key among those that hold its template; all its
    repeats in that row stay. Equal lines within one document alone don't recur.

    A null text stays null with n_lines 0. An empty text has no lines. A text that loses all its lines becomes
    empty. Lines end at line feeds; others are joined again as they were. Rows with the same key, if the smallest,
    all keep their lines; rows with a null key count, but lose nothing. Columns named n_lines or n_dropped are
    replaced; others, whatever their names, go along. Memory: two tiles, each of `tile` lines or of tile_tokens tokens, in
    a task; a longer line is in a tile alone. An empty table gives an empty result.
    """
    plain = small_batches(docs).select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t, h, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(r, i, h, *p) for p in {parse(s, depth, least, similarity, long) for s in (t or "").split("\n")} if p]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row", "id", "carrier", "n", "leaf", "line", "fixed"])

    enough = F.when(F.col("n") >= long, min(long_docs, min_docs)).when(F.col("n") >= least, min_docs).otherwise(max(short_docs, min_docs))
    held = cut(plain.withColumns({"carrier": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).mapInArrow(parsed, "row bigint, id bigint, carrier bigint, n int, leaf bigint, line bigint, fixed boolean"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "carrier"))
    lines = held.groupBy("leaf", "line", "n", "fixed").agg(F.count("*").alias("c"), first.alias("f"))
    lines = cut(lines.select("leaf", "line", "n", "fixed", "c", F.col("f.id").alias("first"), F.col("f.carrier").alias("carrier")))
    exact = lines.where(F.col("c") >= enough).select("line", F.col("first").alias("keep"))

    able = lines.where((F.col("n") >= least_variable) & F.col("fixed"))
    leaves = able.groupBy("leaf").agg(F.count("*").alias("_l"), F.sum("c").alias("_d"), F.first("n").alias("n"))
    # kept, so that Spark can split the join at a leaf with many lines; it can't above an aggregation
    open_ = able.join(cut(leaves.where((F.col("_l") > 1) & (F.col("_d") >= enough)).select("leaf")), "leaf")
    # one document carries the tokens of a line: the first that holds it
    carried = open_.groupBy("first", "carrier").agg(F.collect_list("line").alias("lines"))
    carriers = plain.join(carried, F.col("id").eqNullSafe(F.col("first")) & (F.xxhash64("text") == F.col("carrier"))).select("text", "lines")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wanted = set(wanted)
                for s in (t or "").split("\n"):
                    found = tokens(s)
                    c = code(" ".join(found))
                    if c in wanted:
                        wanted.discard(c)
                        codes = [code(w) for w in found]
                        rows.append((code(" ".join([str(len(found)), *found[:depth]])), c, len(found), codes, *signatures(codes, depth, similarity)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["leaf", "line", "n", "tokens", "sure", "keys"])

    placed = cut(carriers.mapInArrow(spread, "leaf bigint, line bigint, n int, tokens array<bigint>, sure boolean, keys array<bigint>").dropDuplicates(["line"]))
    linked_lines = components(links(placed, similarity, tile, tile_tokens))
    shaped = cut(linked_lines.select(F.col("node").alias("line"), F.col("root").alias("template")))
    # a row that holds several lines of a template counts once
    holders = held.join(shaped, "line").groupBy("template", "row").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    recurring = holders.groupBy("template").agg(F.count("*").alias("_d"), F.min("id").alias("keep"), F.first("n").alias("n")).where(F.col("_d") >= enough)
    by_template = shaped.join(recurring, "template").select("line", "keep")
    exact = exact.join(shaped.select("line"), "line", "left_anti")

    doomed = held.join(exact.unionByName(by_template), "line").where("id <> keep")
    own_id, gone_lines = fresh("_id", docs.columns), fresh("_doomed", docs.columns)
    doomed = doomed.groupBy(F.col("id").alias(own_id)).agg(F.collect_set("line").alias(gone_lines))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*[F.col(f"`{c}`") for c in names]).join(doomed, F.col(key) == F.col(own_id), "left").drop(own_id)
    at = names.index(text)
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).withColumn(text, F.col(text).cast("string")).withColumns({"n_lines": F.lit(0).cast("bigint"), "n_dropped": F.lit(0).cast("bigint")}).schema
    for f in schema:
        f.nullable = True

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for t, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                all_lines = t.split("\n") if t else []
                left = all_lines
                if gone:
                    gone = set(gone)
                    left = [s for s in all_lines if not (p := parse(s, depth, least, similarity, long)) or p[2] not in gone]
                texts.append(t if t is None else "\n".join(left))
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(left))
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return joined.withColumn(text, F.col(text).cast("string")).mapInArrow(cleaned, schema)


def keep_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, without recurring lines. A document that had words and has none left is a
    copy throughout of lines that stand elsewhere, and goes."""
    out = drop_recurring_lines(docs, key, text)
    return out.where((F.col("n_dropped") == 0) | F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])
