"""HTML pages to player records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernglass.functions.text import decode_entities, first_group, full_group, strip, strip_tags
from fernglass.sources.readers import PLAYER

# --- fixed values: what the fields look like, in Java's dialect ((?s) dot takes line ends, (?U) Unicode classes) -----
NAME_IN_SPAN = r"(?s)<h1[^>]*>.*?<span>(.*?)</span>"
NAME_IN_H1 = r"(?s)<h1[^>]*>(.*?)</h1>"
META_UP_TO_SCRIPT = r"""(?s)<div[^>]+id=["']meta["'][^>]*>(.*?)<script"""
ANY_DIV = r"(?s)<div[^>]+>(.*?)</div>"
POSITION = r"(?U)<strong>Position(?:s)?</strong>:\s*([A-Za-z/,\- ]+)"
HEIGHT = r"(?U)<span>(\d{1,2}-\d{1,2})</span>"
WEIGHT = r"(?U)<span>(\d{2,3})lb</span>"
BORN_YEAR = r"(?sU)<strong>Born:</strong>.*?(\d{4})"
BORN_US = r"in&nbsp;([^,]+),&nbsp;<a [^>]+>([A-Z]{2})</a>"
BORN_ABROAD = r"in&nbsp;([^,]+),&nbsp;<a [^>]+>([^<]+)</a>"
COLLEGE = r"(?U)<strong>College</strong>:\s*<a[^>]+>([^<]+)</a>"
HIGH_SCHOOL = r"(?U)<strong>High School</strong>:\s*<a[^>]+>([^<]+)</a>"
DRAFT = r"(?sU)<strong>Draft</strong>:.*?<a[^>]*?>([^<]+)</a>.*?/years/(\d{4})/draft\.htm"
DIED = r"(?sU)<strong>Died:</strong>.*?(\d{4})"
TEAM = r"(?siuU)<strong>Team(?:s)?</strong>:\s*(?:<span>)?<a[^>]+>([^<]+)</a>"
PLAYER_LINK = r'<a href="(/players/[A-Z]/[^"]+\.htm)">[^<]+</a>'
NOT_FOUND, NO_NAME, NO_META, UNDRAFTED, RETIRED, DEAD, ALIVE = "N/A", "Unknown", "Unknown Status (Meta Missing)", "Undrafted", "Retired", "Died", "Alive"
# --------------------------------------------------------------------------------------------------------------------


def page_name(html: Column) -> Column:
    """The heading's text, of its span if there is one after it, without tags; 'Unknown' without a heading."""
    return F.coalesce(strip_tags(F.coalesce(first_group(html, NAME_IN_SPAN), first_group(html, NAME_IN_H1))), F.lit(NO_NAME))


def meta_section(html: Column) -> Column:
    """What follows the meta div up to a script; else the inner texts of all divs that hold one; '' without any."""
    inner = F.filter(F.regexp_extract_all(html, F.lit(ANY_DIV), 1), lambda s: s.contains('id="meta"'))
    return F.coalesce(first_group(html, META_UP_TO_SCRIPT), F.array_join(inner, ""))


def player_fields(meta: Column) -> dict[str, Column]:
    """The fields of a meta section, entities not yet decoded."""
    us, abroad = [[full_group(meta, p, g) for g in (1, 2)] for p in (BORN_US, BORN_ABROAD)]
    place = [F.coalesce(strip(F.when(us[0].isNotNull(), us[g]).otherwise(abroad[g])), F.lit(NOT_FOUND)) for g in (0, 1)]
    died, team = full_group(meta, DIED), full_group(meta, TEAM)
    found = {
        "Position": strip(full_group(meta, POSITION)),
        "Height": full_group(meta, HEIGHT),
        "Weight": F.concat(full_group(meta, WEIGHT), F.lit("lb")),
        "BornYear": full_group(meta, BORN_YEAR),
        "College": strip(full_group(meta, COLLEGE)),
        "HighSchool": strip(full_group(meta, HIGH_SCHOOL)),
    }
    return {k: F.coalesce(v, F.lit(NOT_FOUND)) for k, v in found.items()} | {
        "BornCity": place[0],
        "BornState": place[1],
        "DraftTeam": F.coalesce(strip(full_group(meta, DRAFT, 1)), F.lit(UNDRAFTED)),
        "DraftYear": F.coalesce(full_group(meta, DRAFT, 2), F.lit(UNDRAFTED)),
        "CurrentTeam": F.when(died.isNotNull(), F.lit(DEAD)).otherwise(F.coalesce(strip(team), F.lit(RETIRED))),
        "DiedYear": F.coalesce(died, F.lit(ALIVE)),
    }


#: The record of a page without a meta section, but for its name.
WITHOUT_META = dict.fromkeys(PLAYER[1:], NOT_FOUND) | {"CurrentTeam": NO_META, "DraftTeam": UNDRAFTED, "DraftYear": UNDRAFTED}


def extract_players(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """A record of 13 strings for each page, none null, with the columns in keep before them.

    Name and meta section are found once; the fields come from the meta section. Entities are decoded in records with a
    meta section. A null page counts as empty.
    """
    parts = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("_html"))
    parts = parts.select(*keep, page_name(F.col("_html")).alias("Player"), meta_section(F.col("_html")).alias("_meta"))
    fields = player_fields(F.col("_meta")) | {"Player": F.col("Player")}
    found = F.when(F.col("_meta") != "", F.array(*[fields[c] for c in PLAYER]))
    record = parts.select(*keep, "Player", decode_entities(found).alias("_v"))
    value = lambda i, c: F.when(F.col("_v").isNull(), F.lit(WITHOUT_META[c]) if i else F.col("Player")).otherwise(F.get("_v", F.lit(i)))
    return record.select(*keep, *[value(i, c).alias(c) for i, c in enumerate(PLAYER)])


def player_links(html: Column, host: str, pattern: str = PLAYER_LINK) -> Column:
    """The links of a list page, with host before them, in order, each once."""
    found = F.coalesce(F.regexp_extract_all(html, F.lit(pattern), 1), F.array().cast("array<string>"))
    return F.transform(F.array_distinct(found), lambda p: F.concat(F.lit(host), p))


def links(pages: DataFrame, key: str, html: str, host: str, pattern: str = PLAYER_LINK) -> DataFrame:
    """(key, at, link): the links of each page, at counting from 0."""
    return pages.select(key, F.posexplode(player_links(F.col(html), host, pattern)).alias("at", "link"))


def comment_sections(html: Column, marker: str) -> Column:
    """The comments that hold the marker. The list pages' own filter takes none, so links() doesn't use it."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), 1), lambda s: s.contains(marker))
