"""Results as fixed-width rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions.text import blank_to, first_full, strip


class Shown(NamedTuple):
    title: str
    width: int
    right: bool
    source: str | None = None


# --- fixed values: titles, widths, alignments -----------------------------------------------------------------------
RANK, DOC, SCORE = "#", "Doc ID", "Score"
PLAYERS = (
    Shown(RANK, 3, False), Shown(DOC, 6, True), Shown(SCORE, 7, True), Shown("Player", 22, False, "Player"), Shown("Pos", 3, False, "Position"),
    Shown("H", 4, True, "Height"), Shown("W", 6, True, "Weight"), Shown("Born", 4, True, "BornYear"), Shown("City", 10, False, "BornCity"),
    Shown("St/Ctry", 15, False, "BornState"), Shown("Team", 7, False, "CurrentTeam"), Shown("Died", 4, True, "DiedYear"),
    Shown("College", 12, False, "College"), Shown("Draft", 15, False, "DraftTeam"), Shown("D.Yr", 4, True, "DraftYear"),
)
FIELDED = (
    Shown(RANK, 3, False), Shown(SCORE, 7, True), Shown("Player", 20, False, "player"), Shown("Pos", 3, False, "position"), Shown("College", 12, False, "college"),
    Shown("Team", 10, False, "currentteam"), Shown("H", 4, True, "height"), Shown("W", 6, True, "weight"), Shown("City", 10, False, "borncity"),
    Shown("St/Ctry", 5, False, "bornstate"), Shown("D.Yr", 5, False, "draftyear"),
)
BOOLEAN_SCORE = "Boolean"
OTHER_FIELDS = ("currentteam", "draftteam", "borncity", "bornstate", "bornyear", "draftyear", "height", "weight", "draft_round")
# --------------------------------------------------------------------------------------------------------------------


def cell(value: Column, shown: Shown) -> Column:
    """The value, stripped, cut or filled to the width; null as empty."""
    text = F.coalesce(strip(value.cast("string")), F.lit(""))
    return F.lpad(F.substring(text, 1, shown.width), shown.width, " ") if shown.right else F.rpad(text, shown.width, " ")


def rows(results: DataFrame, layout: tuple[Shown, ...] = PLAYERS, rank: str = "rank", doc: str = "doc_id", score: str | None = "score") -> DataFrame:
    """(rank, line) of ranked results that hold the layout's columns; without a score, as for a Boolean search."""
    special = {RANK: F.col(rank), DOC: F.col(doc) if any(s.title == DOC for s in layout) else F.lit(""), SCORE: F.lit(BOOLEAN_SCORE) if score is None else F.format_string("%.4f", F.col(score))}
    cells = [cell(special[s.title] if s.source is None else F.col(s.source), s) for s in layout]
    return results.select(F.col(rank).alias("rank"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def header(layout: tuple[Shown, ...] = PLAYERS) -> str:
    return "| " + " | ".join(s.title.center(s.width) for s in layout) + " |"


def footer(shown: int, total: int) -> str | None:
    return f"...Displayed only the first {shown} of {total} total results." if total > shown else None


def stored_fields(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "score")) -> DataFrame:
    """What a fielded result shows; empty counts as missing. Missing columns count as null."""
    have = set(df.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    main = {
        "player": F.coalesce(first_full(get("player"), get("full_name_search")), F.lit("Unknown")),
        "position": F.coalesce(first_full(get("position"), get("position_search")), F.lit("N/A")),
        "college": F.coalesce(first_full(get("college"), get("college_search")), F.lit("N/A")),
    }
    shown = {k: F.round(F.col(k), 4) if k == "score" else F.col(k) for k in keep if k in have}
    return df.select(*[c.alias(k) for k, c in (shown | main).items()], *[blank_to(get(c), "N/A").alias(c) for c in OTHER_FIELDS])
