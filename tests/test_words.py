"""Words against the published rules for default word breaks, applied one by one to each place between two characters."""

import random
import unicodedata

import regex
from pyspark.sql import functions as F

from fernglass.functions import text as T

KINDS = ("Katakana", "ALetter", "Hebrew_Letter", "Numeric", "ExtendNumLet", "MidLetter", "MidNum", "MidNumLet", "Single_Quote", "Extend", "Format", "ZWJ")
POOL = list("abzA09.,;:'_ -·’٠١אבàéßкж") + ["́", "한", "글", "カ", "タ", "ー", "ひ", "漢", "­", "‍", "ⅷ", "ª", "１", "․", " ", "/", "\t"]


def kind(c):
    return next((k for k in KINDS if regex.match(rf"\p{{WB={k}}}", c)), "Other")


def words_by_rules(text):
    """Segments between breaks that hold a letter, a digit or katakana; ideographs and hiragana alone."""
    text = text.lower()
    kinds = [kind(c) for c in text]
    skipped = ("Extend", "Format", "ZWJ")
    solid = [i for i, k in enumerate(kinds) if k not in skipped]  # WB4: what extends a character goes with it
    letter, either = ("ALetter", "Hebrew_Letter"), ("MidNumLet", "Single_Quote")
    at = lambda n: kinds[solid[n]] if 0 <= n < len(solid) else None

    def joined(n):
        """No break between the solid characters n - 1 and n."""
        before, a, b, after = at(n - 2), at(n - 1), at(n), at(n + 1)
        return (
            (a in letter and b in letter)  # WB5
            or (a in letter and b in ("MidLetter", *either) and after in letter)  # WB6
            or (before in letter and a in ("MidLetter", *either) and b in letter)  # WB7
            or (a in (*letter, "Numeric") and b in (*letter, "Numeric"))  # WB8 to WB10
            or (before == "Numeric" and a in ("MidNum", *either) and b == "Numeric")  # WB11
            or (a == "Numeric" and b in ("MidNum", *either) and after == "Numeric")  # WB12
            or (a == b == "Katakana")  # WB13
            or (a in (*letter, "Numeric", "Katakana", "ExtendNumLet") and b == "ExtendNumLet")  # WB13a
            or (a == "ExtendNumLet" and b in (*letter, "Numeric", "Katakana"))  # WB13b
        )

    segments = []
    for n, i in enumerate(solid):
        piece = text[i : solid[n + 1] if n + 1 < len(solid) else len(text)]
        if n and joined(n):
            segments[-1] += piece
        else:
            segments.append(piece)
    holds = ("ALetter", "Hebrew_Letter", "Numeric", "Katakana")
    return [s for s in segments if any(kind(c) in holds for c in s) or regex.match(r"[\p{IsHan}\p{IsHiragana}]", s)]


def test_words_against_the_rules(spark):
    assert unicodedata.category(" ") == "Zs"
    random_ = random.Random(3)
    texts = ["".join(random_.choice(POOL) for _ in range(random_.randint(0, 14))) for _ in range(4000)]
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.standard_tokens(F.col("t")).alias("w")).collect()}
    for t in texts:
        assert got[t] == T.words_of(t) == words_by_rules(t), repr(t)


def test_scripts_pictures_and_long_words(spark):
    cases = {
        "ภาษาไทย ລາວ ខ្មែរ မြန်မာ x": ["ภาษาไทย", "ລາວ", "ខ្មែរ", "မြန်မာ", "x"],
        "한국어 タワーx カナ_1 東京": ["한국어", "タワー", "x", "カナ_1", "東", "京"],
        "ok😀👍🏽 👩‍💻 🇩🇪🇫🇷 ☕!": ["ok", "😀", "👍🏽", "👩‍💻", "🇩🇪", "🇫🇷", "☕"],
        "x" * 600 + " y": ["x" * 255, "x" * 255, "x" * 90, "y"],
        "_ __ ... ' -": [],
        "": [],
    }
    rows = spark.createDataFrame([*[(t,) for t in cases], (None,)], "t string").select("t", T.standard_tokens(F.col("t")).alias("w")).collect()
    assert {r.t: r.w for r in rows} == {**cases, None: []}
    assert all(T.words_of(t) == w for t, w in cases.items())


def test_very_long_word_needs_no_stack(spark):
    long = F.repeat(F.lit("a1.2é"), 200_000)
    assert spark.range(1).select(F.size(T.standard_tokens(long)).alias("n")).first().n == -(-1_000_000 // 255)
