"""Column functions on text. All stay in the JVM but decode_entities, for which Spark has no built-in."""

from __future__ import annotations

import html
import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# --- fixed values: the patterns of the two tokenizers --------------------------------------------------------------
#: Runs of ASCII letters and digits, joined by single inner apostrophes or hyphens; applied to lower-cased text.
TOKEN = r"[a-z0-9]+(?:['\-][a-z0-9]+)*"
#: Ideographs and hiragana are words one by one.
ALONE = r"[\p{IsHan}\p{IsHiragana}]"
#: Scripts whose words have no spaces between them: a run of each of their letters and marks is a word.
UNSPACED = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}"
#: Katakana and the marks that go with it.
KATAKANA = r"\p{IsKatakana}\u3031-\u3035\u309b\u309c\u30a0\u30fc\uff70"
#: Marks and formats, which belong to the character before them; not the zero-width space.
IGNORED = r"\p{M}\u200c\u200d\u00ad\u2060-\u2064\u200e\u200f\ufeff"
#: What joins words: underscores and the like.
JOINS = r"\p{Pc}\u202f"
#: What stands between two letters, between two digits, or between two of either kind.
MID_LETTER, MID_NUMBER, MID_BOTH = r":\u00b7\u0387\u055f\u05f4\u2027\ufe13\ufe55\uff1a", r",;\u037e\u0589\u060c\u060d\u066c\u07f8\u2044\ufe10\ufe14\ufe50\ufe54\uff0c\uff1b", r"'.\u2018\u2019\u2024\ufe52\uff07\uff0e"
#: Pictures: blocks of emoji, and those among older symbols that are shown in colour by themselves.
PICTURES = r"\U0001f300-\U0001f3fa\U0001f400-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001faff\u231a\u231b\u23e9-\u23f3\u2614\u2615\u2648-\u2653\u26bd\u26be\u2705\u2728\u274c\u2753-\u2755\u2757\u2764\u2b50"
#: The longest word; longer ones are cut.
LONGEST = 255
# --------------------------------------------------------------------------------------------------------------------


def tokenize(text: Column) -> Column:
    """Tokens of the text in order; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), F.array().cast("array<string>"))


def tokens(text: str | None) -> list[str]:
    """The same of one text, on the driver: for the terms of a query."""
    return re.findall(TOKEN, (text or "").lower())


def counted(words: Column) -> Column:
    """(term, tf) of each different word of an array, in order: runs of the sorted words. A row at a time, without a shuffle."""

    def runs(sorted_: Column) -> Column:
        n = F.size(sorted_)
        is_first = lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1))
        places = F.filter(F.sequence(F.lit(0), n - 1), is_first)
        run = lambda at: F.transform(at, lambda i, k: F.struct(F.get(sorted_, i).alias("term"), (F.coalesce(F.get(at, k + 1), n) - i).cast("bigint").alias("tf")))
        return once(places, run)

    empty = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(words) > 0, once(F.sort_array(words), runs)).otherwise(empty)


def located(words: Column) -> Column:
    """(term, tf, positions) of each different word of an array, positions from 0 in rising order. A row at a time."""

    def runs(pairs: Column) -> Column:
        n = F.size(pairs)
        is_first = lambda i: (i == 0) | (F.get(pairs, i)["term"] != F.get(pairs, i - 1)["term"])
        places = F.filter(F.sequence(F.lit(0), n - 1), is_first)

        def run(at: Column) -> Column:
            length = lambda i, k: F.coalesce(F.get(at, k + 1), n) - i
            return F.transform(at, lambda i, k: F.struct(
                F.get(pairs, i)["term"].alias("term"), length(i, k).cast("bigint").alias("tf"), F.transform(F.slice(pairs, i + 1, length(i, k)), lambda x: x["at"]).alias("positions"),
            ))

        return once(places, run)

    empty = F.array().cast("array<struct<term:string,tf:bigint,positions:array<int>>>")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    return F.when(F.size(words) > 0, once(F.sort_array(placed), runs)).otherwise(empty)


def _astral(pattern: str) -> str:
    """Characters beyond 16 bits as themselves, as regular expressions write them in different ways."""
    return re.sub(r"\\U([0-9a-f]{8})", lambda m: chr(int(m[1], 16)), pattern)


def _word_pattern() -> str:
    """One word by the default Unicode word breaks, in an expression that reads alike in Java and in Python's regex
    module. All repeats are possessive: what follows a run can't begin with what the run took, so none needs to be given
    back, and very long words need no stack."""
    letter = rf"[\p{{IsAlphabetic}}&&[^\p{{M}}\p{{IsHan}}\p{{IsHiragana}}{KATAKANA}{UNSPACED}]]"
    digit = r"[\p{Nd}\u066b]"
    more = f"[{IGNORED}]*+"
    run = lambda c: f"(?:{c}{more})++"
    between = lambda c, mid: rf"{run(c)}(?:[{mid}{MID_BOTH}]{more}{run(c)})*+"
    core = f"(?:(?:{between(letter, MID_LETTER)}|{between(digit, MID_NUMBER)})++|{run(f'[{KATAKANA}]')})"
    joins = rf"(?:[{JOINS}]{more})"
    # a katakana run and a word next to each other are two words, unless joined
    words = f"{joins}*+{core}(?:{joins}++{core})*+{joins}*+"
    unspaced = rf"[{UNSPACED}&&[\p{{L}}\p{{M}}]][{UNSPACED}{IGNORED}&&[\p{{L}}\p{{M}}]]*+"
    picture = rf"[{PICTURES}][{IGNORED}\U0001f3fb-\U0001f3ff]*+(?:(?<=\u200d)[{PICTURES}\u2640\u2642\u2695\u2696\u2708][{IGNORED}\U0001f3fb-\U0001f3ff]*+)*+"
    flag = "[\U0001f1e6-\U0001f1ff]{2}"
    return _astral(f"{ALONE}{more}|{unspaced}|{flag}|{picture}|{words}")


STANDARD_TOKEN = _word_pattern()


def standard_tokens(text: Column) -> Column:
    """Words of a full-text field in order, in lower case, no stop words, by the default Unicode word breaks: letters
    with the marks on them, numbers, both mixed, single apostrophes, full stops and the like inside them, underscores. Ideographs and
    hiragana are words one by one, runs of katakana, and of scripts without spaces, one word; pictures are words, too.
    A word of more than 255 characters is cut into pieces of so many. Hebrew's own rules for quotes aren't applied. No words
    for a null text."""
    words = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(STANDARD_TOKEN), 0), F.array().cast("array<string>"))
    pieces = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / LONGEST).cast("int")), lambda i: F.substr(w, i * LONGEST + 1, F.lit(LONGEST)))
    cut = lambda ws: F.when(F.exists(ws, lambda w: F.length(w) > LONGEST), F.flatten(F.transform(ws, pieces))).otherwise(ws)
    return once(words, cut)


def words_of(text: str) -> list[str]:
    """The same of one text, on the driver: for the words of a query."""
    words = regex.findall(STANDARD_TOKEN, text.lower(), flags=regex.V1)
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind Unicode knows; Spark's trim() takes off spaces alone."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank_to(text: Column, value: str) -> Column:
    """value where the text is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(value))


def once(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), with value evaluated once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group in the first match, null without a match. For patterns whose group can be empty."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def full_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group in the first match, null without a match. For patterns whose group can't be empty: one evaluation."""
    return once(F.regexp_extract(text, pattern, group), lambda x: F.nullif(x, F.lit("")))


def join_full(*parts: Column, sep: str = " ") -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def first_full(*parts: Column) -> Column:
    """The first part that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def digits(text: Column) -> Column:
    """The text's digits; '' where there are none or the text is null."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def strip_tags(text: Column) -> Column:
    """Without tags, each on one line, and stripped."""
    return strip(F.regexp_replace(text, r"(?d)<.*?>", ""))


def surname(name: Column) -> Column:
    """The last word, '' without one."""
    return F.coalesce(F.element_at(F.split(strip(name), r"(?U)\s+"), -1), F.lit(""))


def without_brackets(name: Column) -> Column:
    """Without (...) groups and the space before them, stripped; '' for null."""
    return F.coalesce(strip(F.regexp_replace(name, r"(?U)\s*\([^)]*\)", "")), F.lit(""))


def _decoded(values):  # noqa: ANN001, ANN202
    return None if values is None else [None if v is None else html.unescape(v) for v in values]


#: HTML entities of each string of an array decoded; one crossing to Python for all fields of a row. Declared
#: nondeterministic so that a filter on its result isn't moved below it, where all expressions under it would be
#: written out and evaluated again.
decode_entities = F.udf(_decoded, ArrayType(StringType()), useArrow=True).asNondeterministic()


def natural_key(name: Column) -> Column:
    """A sort key that takes runs of digits as numbers: an array of (text, number)."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit("")).otherwise(p).alias("s"), F.when(p.rlike(r"^\d"), p.cast("decimal(38,0)")).alias("n")))
