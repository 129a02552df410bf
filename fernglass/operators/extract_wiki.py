"""Wiki pages to player records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions.text import blank_to, first_group, full_group, once, strip, surname, without_brackets
from fernglass.sources.readers import WIKI_PLAYER

# --- fixed values ---------------------------------------------------------------------------------------------------
STRONG_SIGNS = ("Infobox NFL player", "Infobox NFL biography", "Infobox American football player", "{{NFL player", "{{American football name")
OTHER_SPORTS = (
    "Infobox football biography", "Infobox footballer", "Infobox soccer", "Infobox Australian rules football", "Infobox Gaelic football",
    "Infobox baseball player", "Infobox baseball biography", "Infobox NBA player", "Infobox basketball player",
)
CATEGORY_PATTERNS = (
    r"(?d)\[\[Category:.*NFL players\]\]",
    r"(?d)\[\[Category:.*National Football League players\]\]",
    r"(?d)\[\[Category:.*(American|Canadian) football.*players\]\]",
)
TEAMS = (
    "Arizona Cardinals", "Atlanta Falcons", "Baltimore Ravens", "Buffalo Bills", "Carolina Panthers", "Chicago Bears", "Cincinnati Bengals",
    "Cleveland Browns", "Dallas Cowboys", "Denver Broncos", "Detroit Lions", "Green Bay Packers", "Houston Texans", "Indianapolis Colts",
    "Jacksonville Jaguars", "Kansas City Chiefs", "Las Vegas Raiders", "Los Angeles Chargers", "Los Angeles Rams", "Miami Dolphins",
    "Minnesota Vikings", "New England Patriots", "New Orleans Saints", "New York Giants", "New York Jets", "Philadelphia Eagles",
    "Pittsburgh Steelers", "San Francisco 49ers", "Seattle Seahawks", "Tampa Bay Buccaneers", "Tennessee Titans", "Washington Commanders",
)
NAMESPACES = ("Category:", "Template:", "Wikipedia:", "User:", "File:", "MediaWiki:")
TITLE = r"(?d)<title>(.*?)</title>"
INFOBOX_VALUE = r"(?siuU)\|\s*{field}\s*=\s*(.*?)(?=(?:\n\s*\||\s*\|\s*\w+\s*=)|\n\s*\}}|\z)"
NEXT_FIELD = r"(?U)\|\s*\w+\s*="
LAST_BAR = r"(?U)\s*\|\s*$"
FIRST_SENTENCE = r"(?sU)'''.+?'''.+?(\.\s|\!|\?)"
#: Markup to take out, in this order: pattern, and what takes its place.
MARKUP = (
    (r"(?s)&lt;ref.*?&lt;/ref&gt;", ""),
    (r"(?s)<ref.*?>.*?</ref>", ""),
    (r"<ref[^>/]*/>", ""),
    (r"(?siuU)\bref\s*\{\{.*?\}\}", ""),
    (r"(?U)\[\d+\]", ""),
    (r"(?s)\{\{.*?\}\}", ""),
    (r"(?U)\[https?://[^\s]+\s+([^\]]+)\]", "$1"),
    (r"\[https?://[^\]]+\]", ""),
    (r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"'{2,}", ""),
    (r"<[^>]+>", ""),
    (r"&[a-z]+;", ""),
    (r"(?U)\s+", " "),
)
#: Where the year of birth stands; an earlier pattern wins over one that is found earlier in the text.
BIRTH_YEAR = (
    r"(?U)\{\{Birth date and age\|(\d{4})\|(\d{1,2})\|(\d{1,2})\}\}",
    r"(?U)\{\{Birth date and age\|[^}]*?\|(\d{4})\|(\d{1,2})\|(\d{1,2})\}\}",
    r"(?U)\{\{Birth-date\|(\d{4})\|(\d{1,2})\|(\d{1,2})\}\}",
    r"(?U)\{\{bda\|(\d{4})\|(\d{1,2})\|(\d{1,2})\}\}",
    r"(?Ud)\{\{birth date\|(\d{4})\|(\d{1,2})\|(\d{1,2})\|.*?\}\}",
    r"(?U)\{\{Birth date\|(\d{4})\|(\d{1,2})\|(\d{1,2})\}\}",
    r"(?U)birth_date\s*=\s*(\d{4})-(\d{1,2})-(\d{1,2})",
    r"(?U)birth_date\s*=\s*\{\{birth date and age\|(\d{4})\|(\d{1,2})\|(\d{1,2})\}\}",
    r"(?U)\{\{Birth year and age\|(\d{4})\}\}",
    r"(?U)\{\{born in\|(\d{4})\}\}",
    r"(?U)\{\{birth year and age\|(\d{4})\}\}",
    r"(?U)born\s*=\s*\{\{birth year and age\|(\d{4})\}\}",
    r"(?U)\{\{Birth\|\s*year\s*=\s*(\d{4})\s*\|\s*month\s*=\s*(\d{1,2})\s*\|\s*day\s*=\s*(\d{1,2})\s*\}\}",
    r"(?U)\{\{death date and age\|\d{4}\|\d{1,2}\|\d{1,2}\|(\d{4})\|\d{1,2}\|\d{1,2}\}\}",
)
WEIGHT_FIELDS = ("weight_lb", "weight_lbs", "weight", "weight_kg")
# --------------------------------------------------------------------------------------------------------------------


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_player_page(page: Column) -> Column:
    """A strong sign, or a category without the infobox of another sport; and a title outside special namespaces."""
    strong = _any([page.contains(s) for s in STRONG_SIGNS])
    category = _any([page.contains(f"[[Category:{t}") for t in TEAMS] + [page.rlike(p) for p in CATEGORY_PATTERNS])
    other = _any([page.contains(s) for s in OTHER_SPORTS])
    return strong | (category & ~other)


def page_title(page: Column) -> Column:
    """The title, null without one."""
    return first_group(page, TITLE)


def is_article(title: Column) -> Column:
    return title.isNotNull() & ~_any([title.contains(n) for n in NAMESPACES])


def clean_markup(text: Column) -> Column:
    """Plain text of wiki markup. Nested templates leave a rest, as each pattern takes the shortest match."""
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return F.coalesce(strip(text), F.lit(""))


def first_sentence(page: Column) -> Column:
    """From the first bold words to the end of their sentence, as plain text; '' without any."""
    return clean_markup(F.regexp_extract(page, FIRST_SENTENCE, 0))


def infobox_field(page: Column, field: str) -> Column:
    """The field's value as plain text; '' without one. A value that runs into the next field counts as none."""
    value = strip(F.regexp_extract(page, INFOBOX_VALUE.format(field=field), 1))
    value = once(value, lambda v: F.when(v.rlike(NEXT_FIELD), F.lit("")).otherwise(v))
    return clean_markup(F.regexp_replace(value, LAST_BAR, ""))


def weight(page: Column) -> Column:
    """The first weight field with a value; a bare number of two or three digits gets ' lb', unless it is in kg."""
    found = []
    for f in WEIGHT_FIELDS:
        value = infobox_field(page, f)
        if f != "weight_kg":
            value = once(value, lambda v: F.when(v.rlike(r"(?U)^\d{2,3}$"), F.concat(v, F.lit(" lb"))).otherwise(v))
        found.append(once(value, lambda v: F.nullif(v, F.lit(""))))
    return F.coalesce(*found, F.lit(""))


def birth_year(page: Column) -> Column:
    """The year of birth, null without one."""
    return F.coalesce(*[full_group(page, p) for p in BIRTH_YEAR])


def extract_wiki_players(pages: DataFrame, page: str = "page") -> DataFrame:
    """A record of 11 strings for each page on a player with a year of birth, duplicates removed, sorted by surname.
    The cheap tests run first, on the raw text; empty fields become 'N/A'."""
    p = F.col(page)
    chosen = pages.where(is_player_page(p) & p.contains("<title>"))
    fields = {f: infobox_field(p, f) for f in ("birth_place", "height_ft", "height_in", "college", "high_school")}
    record = chosen.select(
        page_title(p).alias("_title"), birth_year(p).alias("birth_year"), weight(p).alias("weight_lb"), infobox_field(p, "draftyear").alias("draft_year"),
        infobox_field(p, "draftround").alias("draft_round"), first_sentence(p).alias("info"), *[c.alias(k) for k, c in fields.items()],
    )
    record = record.where(is_article(F.col("_title")) & F.col("birth_year").isNotNull()).withColumn("player_name", without_brackets(F.col("_title")))
    distinct = record.select(*WIKI_PLAYER).distinct()
    plain = ("player_name", "birth_year")
    out = distinct.select(*[F.col(c) if c in plain else blank_to(F.col(c), "N/A").alias(c) for c in WIKI_PLAYER])
    return out.orderBy(surname(F.col("player_name")), *WIKI_PLAYER)
