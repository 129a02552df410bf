"""Joining two sources of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------------
NOT_FOUND = "N/A"
#: The other source's names for the shared columns.
RENAMED = {"birth_year": "BornYear", "birth_place": "BirthPlace", "weight_lb": "Weight", "college": "College", "high_school": "HighSchool", "draft_year": "DraftYear"}
#: The merged columns: from both sources, the first winning; from the first alone; from the second alone.
SHARED = ("Player", "Height", "Weight", "BornYear", "DraftYear", "College", "HighSchool")
FIRST = ("Position", "BornCity", "BornState", "CurrentTeam", "DraftTeam", "DiedYear")
SECOND = {"BirthPlace_Other": "BirthPlace", "draft_round": "draft_round", "info": "info"}
MERGED = (*SHARED, "Position", "BornCity", "BornState", "BirthPlace_Other", "CurrentTeam", "DraftTeam", "draft_round", "DiedYear", "info")
# --------------------------------------------------------------------------------------------------------------------


def all_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def name_key(name: Column) -> Column:
    """What names are compared by: upper case, without spaces at the ends."""
    return F.trim(F.upper(name))


def is_missing(value: Column) -> Column:
    return value.isNull() | (F.upper(F.trim(value)) == NOT_FOUND)


def height(feet: Column, inches: Column) -> Column:
    return F.when(is_missing(feet) | is_missing(inches), F.lit(NOT_FOUND)).otherwise(F.concat_ws("-", feet, inches))


def merged(left: Column, right: Column | None = None, na_as_null: bool = False) -> Column:
    """The left value, else the right one, else 'N/A'. 'N/A' counts as a value unless na_as_null."""
    parts = [left] if right is None else [left, right]
    if na_as_null:
        parts = [F.when(~is_missing(p), p) for p in parts]
    return F.coalesce(*parts, F.lit(NOT_FOUND))


def full_join(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(first, second): structs of the rows of both sides that agree in the keys, null beside a row without a partner. Keys
    are columns of both; nulls match nothing.

    A full outer join can't split a key: all its rows are one task. So rows with a null key, which need no partner looked for,
    go round the join; those with a partner are an inner join, and those without are found by anti joins with the other side's
    keys. Adaptive execution splits a frequent key in all three, on either side.
    """
    whole = [df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")) for df in (first, second)]
    names = [f"_k{i}" for i in range(len(keys))]
    has = F.lit(True)
    for n in names:
        has &= F.col(n).isNotNull()
    a, b = (df.where(has) for df in whole)
    kinds = [df.schema["_row"].dataType for df in whole]
    none = [F.lit(None).cast(kind) for kind in kinds]
    both = a.withColumnRenamed("_row", "first").join(b.withColumnRenamed("_row", "second"), names).select("first", "second")
    # the other side's keys, a few of each at most; dealt by more than the key, so that the join has a shuffle of its own to split
    few = lambda df: df.select(*names, (F.spark_partition_id() % 8).alias("_s")).distinct().select(*names)
    left, right = (x.join(few(y), names, "left_anti").select("_row") for x, y in ((a, b), (b, a)))
    lone = [df.where(~has).select("_row").unionAll(rest) for df, rest in zip(whole, (left, right), strict=True)]
    out = both.unionAll(lone[0].select(F.col("_row").alias("first"), none[1].alias("second")))
    return out.unionAll(lone[1].select(none[0].alias("first"), F.col("_row").alias("second")))


def merge_players(first: DataFrame, second: DataFrame, na_as_null: bool = False, sort: bool = True) -> DataFrame:
    """The full outer join of two sources by name and year of birth, 16 strings without nulls, sorted by Player.

    Many rows may match many. Null keys match nothing; 'N/A' years match each other unless na_as_null. Neither many rows
    without a key nor many of one key gather in one task, nor do they in the sort, which goes on by a hash where names
    are equal.
    """
    a = all_strings(first).withColumn("_key", name_key(F.col("Player")))
    b = all_strings(second)
    b = b.withColumns({"_key": name_key(F.col("player_name")), "Height": height(F.col("height_ft"), F.col("height_in"))}).withColumnsRenamed(RENAMED | {"player_name": "Player"})
    year = F.when(~is_missing(F.col("BornYear")), F.col("BornYear")) if na_as_null else F.col("BornYear")
    joined = full_join(a.withColumn("_year", year), b.withColumn("_year", year), ["_key", "_year"])
    x, y = F.col("first"), F.col("second")
    value = {c: merged(x[c], y[c], na_as_null) for c in SHARED} | {c: merged(x[c]) for c in FIRST} | {k: merged(y[c]) for k, c in SECOND.items()}
    out = joined.select(*[value[c].alias(c) for c in MERGED])
    return out.orderBy("Player", F.xxhash64(*MERGED)) if sort else out


def blanks_to_na(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(NOT_FOUND)).alias(c) if c in columns else F.col(c) for c in df.columns])


def _corrupt(name: str, team: str) -> Column:
    return F.col(name).eqNullSafe("Unknown") | F.col(team).eqNullSafe("Unknown Status (Meta Missing)")


def without_corrupt(df: DataFrame, name: str = "Player", team: str = "CurrentTeam") -> DataFrame:
    """Without records that have no name or no meta section. Nulls are kept."""
    return df.where(~_corrupt(name, team))


def counts(df: DataFrame, name: str = "Player", team: str = "CurrentTeam") -> DataFrame:
    """(processed, kept): how many records there are, and how many without_corrupt() leaves, in one pass."""
    return df.agg(F.count("*").alias("processed"), F.count_if(~_corrupt(name, team)).alias("kept"))
