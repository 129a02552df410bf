import math

import pytest

from fernglass.operators import display, fielded

ROWS = [
    (0, "Tom Brown", "QB", "Big State", "Bears", "6-2", "210lb", "quick red fox"),
    (1, "Tim Brown", "WR", "Small State", "Jets", "5-9", "N/A", "red quick fox"),
    (2, "Sam Green", "QB", "", "Bears", "6-2", "190", "nothing"),
    (3, "Brown Brown Smith", "K", None, "Colts", "-", "210", "a fox is quick"),
]
BOOSTS = {"full_name_search": 10.0, "position_search": 8.0, "college_search": 1.0, "player": 9.0, "position": 7.0, "college": 1.0, "currentteam": 7.0, "info": 0.1}


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, Player string, Position string, College string, CurrentTeam string, Height string, Weight string, info string")
    low = fielded.derived_fields(rows)
    return fielded.build(low, [*BOOSTS, "height_text", "weight_text"], ["height", "weight"])


@pytest.mark.parametrize(
    "query, ids",
    [
        ("brown", {0, 1, 3}), ("tom green", {0, 2}), ("brown AND bears", {0}), ("brown and bears", {0}), ("qb NOT brown", {2}), ("tom AND sam NOT smith", {0, 2}), ("NOT tom", set()),
        ("210", {0, 3}), ("6-2", {0, 2}), ("-", {3}), ("6-2 AND qb", {0, 2}), ("brown NOT 210", {1}), ('"quick red"', {0}), ('"red fox"~1', {0, 1}), ("player:green", {2}), ("  ", set()),
        ("bro*", {0, 1, 3}), ("t?m", {0, 1}), ("tom~1", {0, 1}), ("+tom -green", {0}), ("(tom OR sam) -bears", {0, 2}), ("player:[s TO z]", {0, 1, 2, 3}), ("player:tom AND position:qb", set()), ("player:tom && position:qb", {0}), ("(", set()),
        ("n/a", set()), ("height_text:6", {0, 2}),
    ],
)
def test_hits(made, query, ids):
    assert {r.doc_id for r in fielded.search_all(made, query, BOOSTS).collect()} == ids


def test_strict_and(made):
    assert {r.doc_id for r in fielded.search_all(made, "tom AND bears NOT smith", BOOSTS, strict_and=True).collect()} == {0}


def test_scores(made):
    got = {r.doc_id: r.score for r in fielded.search_all(made, "smith", {"player": 9.0}).collect()}
    assert got[3] == pytest.approx(9 * math.log(1 + 3.5 / 1.5) * 1 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2.25)))
    exact = {r.doc_id: r.score for r in fielded.search_all(made, "210", BOOSTS).collect()}
    assert exact[0] == pytest.approx(14 * math.log(1 + 2.5 / 2.5) / 2.2)
    top = fielded.search(made, "brown", 2, BOOSTS).collect()
    assert [r.doc_id for r in top] == [3, 0] and round(top[0].score, 4) == top[0].score


def test_save_and_load(spark, made, tmp_path):
    made.save(str(tmp_path))
    again = fielded.FieldIndex.load(spark, str(tmp_path))
    assert fielded.search(again, "brown", 5, BOOSTS).collect() == fielded.search(made, "brown", 5, BOOSTS).collect()


def test_derived(made):
    rows = {r.doc_id: r for r in made.docs.collect()}
    assert rows[0].weight == "210" and rows[1].weight == "" and rows[2].college_search is None and rows[3].college == "" and rows[0].full_name_search == "Tom Brown"


def test_display(spark, made):
    shown = display.stored_fields(made.docs.withColumnRenamed("info", "i"))
    line = display.rows(shown.selectExpr("doc_id + 1 as rank", "1.23456D as score", "*"), display.FIELDED).orderBy("rank").first().line
    assert line == "| 1   |  1.2346 | Tom Brown            | QB  | Big State    | Bears      |  6-2 |    210 | N/A        | N/A   | N/A   |"
    assert display.header(display.FIELDED).startswith("|  #  |  Score  |") and display.footer(10, 12).startswith("...") and display.footer(2, 2) is None


@pytest.mark.parametrize(
    "query, ids",
    [
        ("player:{brown TO tom}", {1, 2, 3}), ("player:[brown TO tom}", {0, 1, 2, 3}), ("player:{tim TO tom]", {0}), ("player:{smith TO *}", {0, 1}), ("player:tmo~1", {0}), ("player:bronw~1", {0, 1, 3}),
        ("player:bronw~2", {0, 1, 3}), ('info:"fox quick"~1', {3}), ('info:"fox quick"~2', {1, 3}), ('info:"fox quick"~3', {0, 1, 3}), ('info:"quick fox red"~4', {0, 1}),
    ],
)
def test_syntax(made, query, ids):
    assert {r.doc_id for r in fielded.search_all(made, query, BOOSTS).collect()} == ids


def test_append(spark, made, tmp_path):
    rows = spark.createDataFrame(ROWS, "doc_id long, Player string, Position string, College string, CurrentTeam string, Height string, Weight string, info string")
    low = fielded.derived_fields(rows)
    for k in (0, 1):
        fielded.build(low.where(f"doc_id % 2 = {k}"), [*BOOSTS, "height_text", "weight_text"], ["height", "weight"]).save(str(tmp_path), "append")
    whole = fielded.FieldIndex.load(spark, str(tmp_path))
    for q in ("smith", "brown", "210", '"quick red"', "bro*"):
        assert sorted(fielded.search(whole, q, 5, BOOSTS).collect()) == sorted(fielded.search(made, q, 5, BOOSTS).collect())


def test_results_with_fields(made):
    got = fielded.search_with_fields(made, "brown", 2, BOOSTS).collect()
    assert [(r.doc_id, r.player, r.college, r.weight) for r in got] == [(3, "Brown Brown Smith", "N/A", "210"), (0, "Tom Brown", "Big State", "210")]


def test_ideographs_are_words(spark):
    from fernglass.functions.text import standard_tokens, words_of
    from pyspark.sql import functions as F

    text = "東京 Tower タワー ひら \U00020000x O'Brien 5-10 1,5"
    want = ["東", "京", "tower", "タワー", "ひ", "ら", "\U00020000", "x", "o'brien", "5", "10", "1,5"]
    assert spark.range(1).select(standard_tokens(F.lit(text)).alias("t")).first().t == want == words_of(text)


def test_dictionary_candidates(spark):
    """Every term that fits is among the candidates: for all pairs of many words, at most two edits apart."""
    import random

    from pyspark.sql import functions as F

    from fernglass.operators import dictionary

    random_ = random.Random(6)
    words = {"".join(random_.choice("abc") for _ in range(random_.randint(1, 11))) for _ in range(250)} | {"a", "ab", "naïve", "日本語", "\U00020000x"}
    df = spark.createDataFrame([("f", w, 1) for w in words], "field string, term string, df long")
    held = dictionary.make(df)
    variants, grams = {}, {}
    for r in held.deletions.collect():
        variants.setdefault(r.variant, set()).add(r.term)
    for r in held.grams.collect():
        grams.setdefault(r.gram, set()).add(r.term)
    assert max(len([v for v in variants if w in variants[v]]) for w in words) <= 37

    def apart(a, b):
        rows = [list(range(len(b) + 1))]
        for i, x in enumerate(a):
            row = [i + 1]
            for j, y in enumerate(b):
                row.append(min(rows[i][j + 1] + 1, row[j] + 1, rows[i][j] + (x != y)))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    row[-1] = min(row[-1], rows[i - 1][j - 1] + 1)
            rows.append(row)
        return rows[-1][-1]

    for value in random_.sample(sorted(words), 60) + ["zz", "abcabcabcabcabc"]:
        near = {w for v in dictionary.variants(value) for w in variants.get(v, ())}
        assert {w for w in words if apart(w, value) <= 2} <= near
    edits = {r.term: r.e for r in df.select("term", dictionary.edits_between(F.col("term"), "abcab", 2).alias("e")).collect()}
    assert edits == {w: d if (d := apart(w, "abcab")) <= 2 else None for w in words}
    for pattern in ("a?b*", "*bca*", "abc*", "*c", "日*語", "a"):
        want = {w for w in words if fielded.re.fullmatch(pattern.replace("*", ".*").replace("?", "."), w)}
        own = dictionary.literal_grams(pattern)
        got = set.intersection(*[grams.get(g, set()) for g in own]) if own else words
        assert want <= got
    assert held.fitting("?*") is None and dictionary.literal_grams("ab") == ["^ab", "ab$"]


@pytest.mark.parametrize("query", ["b?own", "*row*", "bro*", "tmo~1", "bronw~2", "/t[io]m/", "player:[brown TO sam]", "zzz~2", "*", "+*ro* -t?m"])
def test_saved_dictionary_gives_the_same(spark, made, tmp_path, query, monkeypatch):
    """By dictionary, by the table of terms, or by postings where a pattern has too many terms."""
    made.save(str(tmp_path))
    saved = fielded.FieldIndex.load(spark, str(tmp_path))
    want = sorted(fielded.search_all(made, query, BOOSTS).collect())
    assert sorted(fielded.search_all(saved, query, BOOSTS).collect()) == want
    if "~" not in query:
        monkeypatch.setattr(fielded, "MOST_TERMS", 0)
        assert sorted(fielded.search_all(saved, query, BOOSTS).collect()) == want


def test_match_all_and_regex(made):
    every = {r.doc_id: r.score for r in fielded.search_all(made, "*:*", BOOSTS).collect()}
    assert set(every) == {0, 1, 2, 3} and all(s == pytest.approx(sum(BOOSTS.values())) for s in every.values())
    hits = lambda q: {r.doc_id for r in fielded.search_all(made, q, BOOSTS).collect()}
    assert hits("*:* AND *:*") == {0, 1, 2, 3}
    assert hits("/t[io]m/") == {0, 1} and hits("/ro/") == set() and hits(r"player:/b.*n/") == {0, 1, 3}


def test_fuzzy_scores(made):
    """Blended: each term counts as if as frequent as the most frequent, times its nearness."""
    got = {r.doc_id: r.score for r in fielded.search_all(made, "tim~1", {"player": 1.0}).collect()}
    exact = {r.doc_id: r.score for r in fielded.search_all(made, "tim", {"player": 1.0}).collect()}
    assert set(got) == {0, 1} and got[1] == pytest.approx(exact[1]) and got[0] == pytest.approx(exact[1] * (1 - 1 / 3))


def test_generations(spark, tmp_path):
    """Appended again, changed, deleted and appended after that: as if only the newest had ever been there."""
    from pyspark.sql import functions as F

    def built(rows):
        return fielded.build(spark.createDataFrame(rows, "doc_id long, a string, b string"), ["a", "b"])

    rows = [(i, f"red w{i % 3}", None if i % 4 == 0 else "blue blue") for i in range(20)]
    path, once = str(tmp_path / "many"), str(tmp_path / "once")
    built([(i, "old red red", "gone") for i, _, _ in rows] + [(99, "red", "gone"), (98, "red", "gone")]).save(path, "append")
    built(rows[:10]).save(path, "append")
    built(rows).save(path, "append")
    fielded.FieldIndex.delete(spark.createDataFrame([(99,), (98,), (99,), (5,), (1234,)], "doc_id int"), path)
    built([rows[5], (98, "red again", "blue")]).save(path, "append")
    want = built([*rows, (98, "red again", "blue")])
    want.save(once)
    compacted = fielded.FieldIndex.compact(spark, path, str(tmp_path / "compacted"))
    for got in (fielded.FieldIndex.load(spark, path, newest=True), compacted):
        for name in ("docs", "postings", "stats", "df"):
            x, y = getattr(got, name), getattr(want, name)
            assert sorted(map(str, x.select(*sorted(y.columns)).collect())) == sorted(map(str, y.select(*sorted(y.columns)).collect())), name
        for q in ("red", "blue w1", "gone", "old", "w*", "a:agian~2"):
            assert sorted(fielded.search(got, q, 50, {"a": 2.0, "b": 1.0}).collect()) == sorted(fielded.search(want, q, 50, {"a": 2.0, "b": 1.0}).collect())
    assert {r.doc_id for r in fielded.search_all(fielded.FieldIndex.load(spark, path), "gone", {"b": 1.0}).collect()} == {*range(20), 98, 99}


@pytest.mark.parametrize("query, ids", [("(tom NOT brown", set()), ("brown NOT (tom", {0, 1, 3}), ("(tom AND qb NOT smith", {0, 2}), ("(tom AND qb", set()), ("qb NOT /[a/", {0, 2}), ("/[a/", set()), ("( AND ( NOT (", set())])
def test_sides_that_cant_be_read(made, query, ids):
    """They fit nothing; the other sides stand."""
    assert {r.doc_id for r in fielded.search_all(made, query, BOOSTS).collect()} == ids
