"""URL filters: host and path rules, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules of the query: host, path, verdict.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

_AFTER = r"(?s)^.*?://(.*)$"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, with A to Z lower-cased; empty without '://'."""
    host = F.regexp_extract(F.regexp_extract(url, _AFTER, 1), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty without '://'."""
    return F.coalesce(F.regexp_extract(F.regexp_extract(url, _AFTER, 1), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule fits its host and all subdomains, if
    the path starts with the rule's. Of rules of one length, the first in code-point order."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))[::-1]:
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        best = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(best)
    return best


def _with_node(df: DataFrame, url: str, name: str) -> DataFrame:
    """Adds what names the page: the URL without its fragment, scheme and host in lower case; null without '://'."""
    df = df.withColumn("_bare", F.regexp_replace(F.trim(url), r"(?s)#.*$", ""))
    rest = F.regexp_extract("_bare", r"(?s)^.*?://[^/?#]*(.*)$", 1)
    scheme = F.lower(F.regexp_extract("_bare", r"(?s)^(.*?)://", 1))
    return df.withColumn(name, F.when(F.col("_bare").contains("://"), F.concat(scheme, F.lit("://"), host_of(F.col("_bare")), rest))).drop("_bare")


def _with_resolved(df: DataFrame, base: str, target: str, name: str) -> DataFrame:
    """Adds target as an absolute URL, seen from base; null where there is none."""
    b, t = F.col(base), F.col("_t")
    df = df.withColumns({"_t": F.trim(target), "_scheme": F.regexp_extract(b, r"(?s)^(.*?)://", 1), "_host": host_of(b), "_path": path_of(b)})
    root = F.concat("_scheme", F.lit("://"), "_host")
    folder = F.coalesce(F.nullif(F.regexp_extract("_path", r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    full = (
        F.when(t.isNull() | (t == ""), None)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t)
        .when(t.startswith("//"), F.concat("_scheme", F.lit(":"), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, F.col("_path"), t))
        .otherwise(F.concat(root, folder, t))
    )
    return df.withColumn(name, full).drop("_t", "_scheme", "_host", "_path")


def _attribute(tag: Column, name: str) -> Column:
    """The attribute's value, quoted or bare; empty where it is missing."""
    parts = [F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{form}", 1) for form in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): pages joined to the target of their canonical link or of their redirect (meta refresh), each named
    by its URL without fragment. Pages without such markup, or without a URL, give none."""
    page = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    page = page.where(F.col("url").contains("://") & (F.col("html").rlike(r"(?i)canonical") | F.col("html").rlike(r"(?i)http-equiv")))
    tags = page.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag"))
    tags = tags.withColumns({k: _attribute(F.col("tag"), n) for k, n in (("rel", "rel"), ("href", "href"), ("equiv", "http-equiv"), ("content", "content"))})
    canonical = F.when(F.lower("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href"))
    refresh = F.when(F.lower("equiv") == "refresh", F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    # cut where expressions would otherwise be written into each other, many times over
    to = cut(tags.select("url", F.coalesce(canonical, refresh).alias("to")).where("to is not null"))
    full = cut(_with_resolved(to, "url", "to", "full"))
    ends = cut(_with_node(_with_node(full, "url", "a"), "full", "b").select("a", "b"))
    return ends.where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url", html: str = "html", edges: DataFrame | None = None) -> DataFrame:
    """A verdict for each page.

    Returns key, host, path, rule (the longest that fits, like 'net/', else null), verdict and alias_of (the
    smallest URL of the page's class of aliases, where it has one). A page that a rule fits gets that rule's
    verdict, so an explicit allow holds whatever its aliases. A page without a rule is blocked if a URL of its
    class is blocked by a rule of its own, else allowed. Classes are the connected components of edges (a, b; by
    default alias_edges of the pages); URLs that are no pages count, too.

    A null URL, or one without '://', has empty host and path, fits no rule, has no aliases and is allowed. Null
    html has no edges. Repeated pages are judged alike. Other columns aren't read.
    """
    named = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("_u"))
    judged = _with_node(named.withColumns({"host": host_of(F.col("_u")), "path": path_of(F.col("_u"))}), "_u", "_n")
    judged = judged.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    classes = components(edges if edges is not None else alias_edges(pages, url, html))
    own = classes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}).withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    blocked = own.groupBy("root").agg(F.max((F.coalesce("_r.verdict", F.lit("")) == "block").cast("int")).alias("_b"))
    # only classes over links are joined, one row for each URL in them
    marked = classes.join(blocked, "root").select(F.col("node").alias("_m"), F.col("root").alias("alias_of"), "_b")
    out = judged.join(marked, F.col("_n") == F.col("_m"), "left")
    by_method = F.when(F.col("_b") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), by_method).alias("verdict"), "alias_of")
