"""Mixing sources to target weights: Pareto order sampling of whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, global_index, hash_unit, identity, running_before, word_count


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds divided by inclusion odds; the smallest ranks make a sample of fixed size whose inclusion
    probabilities come close to those asked for. inclusion lies strictly between 0 and 1, as does u."""
    return (u / (1 - u)) / (inclusion / (1 - inclusion))


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to a table of (source, source_size).

    The sources in order of code point, null last, weigh as in weights, again and again. They divide share times
    the total size by weight; a target above most times its source's size stops there, and the excess goes to the
    others by weight until none is above. Each round is one aggregation over the table of sources that returns four
    numbers; a source that has stopped stays so, so rounds end. Sources without words have target 0; an empty table gives
    an empty result.
    """
    ranked = global_index(sources, [F.col("source").asc_nulls_last()], "_i")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        over = F.col("_cap") <= F.col("_w") * F.lit(level)
        if stopped < 0:
            over = F.lit(False)
        n, caps, rest = ranked.agg(
            F.sum(over.cast("int")), F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(~over, F.col("_w")).otherwise(0.0))
        ).first()
        if n is None or n == stopped or not rest:
            break
        stopped, level = n, (share * total - caps) / rest
    by_weight = F.col("_w") * F.lit(level)
    return ranked.select("source", "source_size", F.when(F.col("_cap") <= by_weight, F.col("_cap")).otherwise(by_weight).alias("target"))


def sample_rate(strata: DataFrame, most: float = 2.0) -> DataFrame:
    """(source, rate) for a table of (source, target, favour, words): a stratum's documents are expected in
    min(most, rate * favour) copies each, such that the source's words come to its target.

    The strata of most favour stop at most. With those above a stratum stopped, the rate is what the target leaves over
    the favour-weighted words of the rest; it is right at the first stratum that it doesn't lift above most. A null rate
    means that all strata stop. A source has few strata, so its rows in the window are few.
    """
    above = Window.partitionBy("source").orderBy(F.col("favour").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.col("favour").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(above), F.lit(0))
    rates = strata.withColumn("_l", left / F.nullif(F.sum(F.col("favour") * F.col("words")).over(rest), F.lit(0)))
    able = F.col("_l") * F.col("favour") <= F.lit(float(most))
    return rates.groupBy("source").agg(F.max_by(F.when(able, F.col("_l")), F.when(able, F.col("favour"))).alias("rate"))


def _decide(docs: DataFrame, key: str, text: str, source: str, weights: Sequence[int], share: float, most: float, favour: Column | None) -> DataFrame:
    """What mix() returns, with the identity (_i, _j) of the row."""
    words = word_count(F.col(text).cast("string"))
    marks = identity(docs)
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text).cast("string")))  # rows without a key are told apart by their text
    sized = docs.select(F.col(key).alias(key), F.col(source).cast("string").alias("source"), words.alias("size"), hash_unit(name, F.lit("mix")).alias("_u"), marks[0].alias("_i"), marks[1].alias("_j"), *([] if favour is None else [favour.alias("favour")]))
    if favour is None:
        sized = sized.withColumn("favour", F.length(F.bin("size")).cast("bigint"))
    sized = cut(sized)
    strata = sized.groupBy("source", "favour").agg(F.sum("size").alias("words"))
    goals = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goals = goals.select(F.col("source").alias("_s"), "source_size", "target")
    strata = cut(strata.join(goals, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    rates = sample_rate(strata, most).select(F.col("source").alias("_r"), "rate")
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("rate") * F.col("favour"), F.lit(float(most))))
    # certain: the words of whole copies; a sum of whole numbers over strata, so the same in any order
    certain = strata.join(rates, F.col("source").eqNullSafe(F.col("_r"))).groupBy("_r", "rate", "source_size", "target").agg(F.sum(F.floor(expected) * F.col("words")).alias("_c"))
    certain = cut(certain)
    # the hot source is a key with many rows on one side and a single row on the other; Spark splits such a join where no
    # aggregation stands below it
    joined = sized.join(certain, F.col("source").eqNullSafe(F.col("_r"))).withColumn("_e", F.when(F.col("size") > 0, expected).otherwise(0.0))
    joined = joined.withColumn("_whole", F.floor("_e")).withColumn("_part", F.col("_e") - F.col("_whole"))
    rank = F.when(F.col("_part") > 0, pareto_rank(F.col("_u"), F.col("_part")))
    joined = cut(joined.select(key, "source", "size", "source_size", "target", "_whole", "_part", "_c", rank.alias("_q"), "_i", "_j"))
    # documents without a part add nothing
    queued = running_before(joined, ["source"], ["_q", key, "size", "_i", "_j"], F.when(F.col("_part") > 0, F.col("size")).otherwise(0), "_before")
    # a document is in if its middle word is among the words still wanted
    extra = ((F.col("_part") > 0) & (F.col("_before") + F.col("size") / 2 <= F.col("target") - F.col("_c"))).cast("bigint")
    copies = (F.col("_whole") + extra).cast("bigint")
    return queued.select(key, "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_i", "_j")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
    most: float = 2.0, favour: Column | None = None,
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns key, size (words), source, source_size, target (of its source), copies and taken (copies times size). A
    document is expected in min(most, rate * favour) copies, the source's rate being such that its words come to the
    target (sample_rate). favour is a positive whole number, by default the binary digits of the size: a text of twice
    the words counts one more. It takes few values; rows of one are a stratum. The whole part of the expected copies is
    taken for certain; with the rest as inclusion probability, the source's documents are ranked by random odds over
    inclusion odds, and the first are sampled: as many as fill, in words, what the certain copies leave of the target. So
    the sample's size is fixed in words, a source misses its target by half a document at most, no document is taken in
    part, and none more than ceil(most) times.

    A null source is a source of its own. A null or empty text has size 0 and is taken 0 times over; a source
    without words has target 0. The random odds depend on the key, without a key on the text. Rows with the same key
    are rows of their own, equal rows in any order. An empty table gives an empty result. Other columns tell rows with
    the same key apart, whatever their names, and nothing else.
    """
    return _decide(docs, key, text, source, weights, share, most, favour).drop("_i", "_j")


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, favour: Column | None = None
) -> DataFrame:
    """The documents, all columns, each repeated as often as the mix takes it; those not taken go. Rows are found by their
    identity, so keys may be null or repeated: each row of docs is one row of mix() and gets that one's copies. Equal rows
    meet as one row on one side of the join, each with its copies on the other."""
    decided = cut(_decide(docs, key, text, source, weights, share, most, favour).select("copies", "_i", "_j"))
    i, j, c = (fresh(n, docs.columns) for n in ("_i", "_j", "_c"))
    marks = identity(docs)
    marked = docs.withColumns({i: marks[0], j: marks[1]})
    if not decided.groupBy("_i", "_j").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        marked = marked.dropDuplicates([i, j])
    picked = decided.where("copies > 0").select(F.col("_i").alias(i), F.col("_j").alias(j), F.col("copies").cast("int").alias(c))
    out = marked.join(picked, [i, j])
    return out.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*[F.col(f"`{n}`") for n in docs.columns])
