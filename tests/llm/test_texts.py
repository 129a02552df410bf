import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fernglass.llm import labelled, line_templates, ngram_join, quality, shingles, toxicity

WORDS = [a + b for a in "bcdfghjklm" for b in ("a", "e", "i", "o", "un", "ar", "el")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def near_corpus():
    r = random.Random(4)
    rows = []
    for c in range(12):
        base = prose(r, 60).split()
        for k in range(r.randint(1, 9)):
            words = list(base)
            for _ in range(k // 2):
                words[r.randrange(len(words))] = prose(r, 1)
            rows.append(" ".join(words))
    hot = prose(r, 120).split()
    for k in range(60):
        words = list(hot)
        words[k] = "changed"
        rows.append(" ".join(words))
    rows += [rows[-1].upper(), rows[0], "", None, " \n ", "one two", "one two", "one two three four five", None]
    return list(enumerate(rows))


def jaccard_truth(rows, threshold=0.8):
    def grams(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    links, root = {i: 0 for i, _ in sets}, {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return links, {i: find(i) for i in root}


@pytest.mark.parametrize("tile, shingles_", [(512, 1_000_000), (9, 1_000_000), (512, 700)])
def test_near_texts(documents, tile, shingles_):
    rows = near_corpus()
    links, roots = jaccard_truth(rows)
    got = ngram_join.near_texts(documents(rows), tile=tile, tile_shingles=shingles_).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.n_links for r in got} == links and {r.doc_id: r.component_id for r in got} == roots
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and max(links.values()) > 50


def test_near_texts_long(documents):
    r = random.Random(9)
    base = prose(r, 30_000).split()
    near, far = list(base), list(base)
    near[100] = near[20_000] = "changed"
    far[::12] = ["other"] * len(far[::12])
    rows = [(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(far)), (8, "short one")]
    links, roots = jaccard_truth(rows)
    got = ngram_join.near_texts(documents(rows), tile_shingles=1000).collect()
    assert {x.doc_id: (x.n_links, x.component_id) for x in got} == {i: (links[i], roots[i]) for i, _ in rows} and roots[6] == 5 and roots[7] == 7


def test_near_texts_edges(documents):
    assert ngram_join.near_texts(documents([])).count() == 0
    text, other = prose(random.Random(1), 30), prose(random.Random(2), 30)
    got = ngram_join.near_texts(documents([(3, text), (3, text), (None, text), (3, other), (9, other + " x")])).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.component_id) for r in got) == [(0, 2, 3), (3, 1, 3), (3, 2, 3), (3, 2, 3), (9, 1, 3)]


@pytest.mark.parametrize("rows", [
    [(3, "A"), (3, "A"), (None, "A"), (4, "A"), (5, "B"), (6, None), (7, ""), (7, "")],
    [(3, "A"), (3, "B"), (3, "C")], [(3, "A"), (3, "B"), (3, "B"), (2, "B"), (None, "C"), (None, "C"), (None, "C")], [(None, "A"), (None, "B"), (1, None), (None, None)],
])
def test_keep_first(documents, rows):
    """By row: null and shared keys neither lose nor multiply texts."""
    texts = {c: prose(random.Random(k), 30) for k, c in enumerate("ABC")}
    rows = [(i, texts.get(t, t)) for i, t in rows]
    docs = documents(rows)
    out = ngram_join.keep_first(docs)
    assert out.columns == docs.columns
    want = Counter(r for r in rows if not r[1])
    for t in texts.values():
        keys = [i for i, x in rows if x == t]
        if keys:
            want[min((i for i in keys if i is not None), default=None), t] += 1
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def test_bands():
    bands, rows = shingles.choose_bands(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        shingles.choose_bands(0.01, 0.9999)
    a = shingles.shingle_set(prose(random.Random(3), 400))
    assert (shingles.band_codes(a, bands, rows) == shingles.band_codes(a[::-1].copy(), bands, rows)).all()


def test_intersections():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j)]
    assert ngram_join.intersections(sets, i, j, columns=16).tolist() == want == [ngram_join.intersections(sets, i[k : k + 1], j[k : k + 1])[0] for k in range(len(i))]


LINES = [
    (1, "Released under the MIT License here.\nmy own first line of text\nSession opened for user ann on host alpha just now"),
    (2, "Released under the MIT License here.\nSession opened for user bob on host alpha just now\nshort"),
    (3, "a line of its own, no more\nReleased under the MIT License here.\nReleased under the MIT License here.\nshort"),
    (4, "Session opened for user cy on host alpha just now\nshort\nitem 17 of the great big list of things we have"),
    (5, "item 18 of the great big list of things we have\n\nshort"),
    (6, "item 19 of the great big list of things we have"),
    (7, None),
    (8, ""),
    (9, "1 2 3\n4 5 6"),
    (10, "7 8 9"),
    (11, "1 1 1\r\nkeep\r"),
    (None, "Released under the MIT License here."),
]


def test_lines(documents):
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(LINES)).collect()}
    assert len(got) == len(LINES)
    assert got[1].text == LINES[0][1]  # the first keeps all
    assert got[2].text == "short" and got[2].n_dropped == 2 and got[2].n_lines == 3
    assert got[3].text == "a line of its own, no more\nshort" and got[3].n_dropped == 2
    assert got[4].text == "short\nitem 17 of the great big list of things we have"
    assert got[5].text == "\nshort" and got[6].text == "" and got[7].text is None and got[8].text == ""
    assert got[9].text == "1 2 3\n4 5 6" and got[10].text == "7 8 9" and got[11].text == "1 1 1\r\nkeep\r"  # fields alone aren't a template
    assert got[None].n_dropped == 0


def test_line_stage(documents):
    docs = documents(LINES)
    out = line_templates.keep_lines(docs)
    assert out.columns == docs.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]
    assert line_templates.drop_recurring_lines(documents([])).count() == 0
    same = line_templates.drop_recurring_lines(documents([(1, LINES[0][1])] * 4)).collect()
    assert all(r.n_dropped == 0 for r in same)  # rows of one key are all the first


def test_lines_long(documents):
    line = prose(random.Random(8), 60)
    rows = [(i, "\n".join([f"own {prose(random.Random(100 + i), 20)}", line])) for i in range(30)] + [(99, prose(random.Random(9), 30_000))]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 and line not in got[i].text for i in range(1, 30)) and got[99].n_dropped == 0


def edited(words, *places):
    return " ".join(f"new{chr(97 + p % 26)}{chr(97 + p // 26)}" if p in places else w for p, w in enumerate(words))


def test_lines_edited_copies_of_a_verbatim_line(documents):
    words = prose(random.Random(10), 30).split()
    rows = [(i, edited(words)) for i in range(20)] + [(20, edited(words, 7)), (21, edited(words, 12)), (22, edited(words, *range(13, 20))), (None, edited(words, 9))]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert [i for i in range(23) if got[i].n_dropped == 0] == [0, 22]  # 22 differs in 7 of 30 tokens
    assert got[None].n_dropped == 0


@pytest.mark.parametrize("n", [3, 4, 50, 1000])
def test_lines_versions(documents, n):
    words = prose(random.Random(11), 60).split()
    rows = [(i, f"{edited(words, 3 + i % 57)} x{'y' * (i // 57)}") for i in range(n)]
    names = [prose(random.Random(i), 3).replace(" ", "") for i in range(40)]
    rows += [(2000 + i, f"Session opened for user {names[i % 40]} on host {names[i * 7 % 40]}s just now") for i in range(n)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert [i for i in got if got[i].n_dropped == 0] == [0, 2000]


def test_lines_versions_in_one_document(documents):
    # a document that holds many versions counts once
    rows = [(i, "\n".join(f"Session opened for user {prose(random.Random(9 * i + k), 1)} on host alpha just now" for k in range(9))) for i in range(2)]
    got = line_templates.drop_recurring_lines(documents(rows)).collect()
    assert all(r.n_dropped == 0 for r in got)


def test_lines_tiles(documents):
    """Against brute force, with leaves of one tile and of many."""
    r = random.Random(12)
    rows = [(i, " ".join(["and", "so", "on", *(r.choice("abcd") for _ in range(7))])) for i in range(150)]
    lines = [t.split() for _, t in rows]
    near = [[sum(a == b for a, b in zip(x, y)) >= 8 for y in lines] for x in lines]
    want, seen = set(), set()
    for i in range(150):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                x = todo.pop()
                todo += (found := {y for y in range(150) if near[x][y]} - group)
                group |= found
            seen |= group
            want |= group - {min(group)} if len(group) >= 3 else set()
    for tile in (512, 16):
        got = line_templates.drop_recurring_lines(documents(rows), tile=tile).collect()
        assert {x.doc_id for x in got if x.n_dropped} == want and 0 < len(want) < 149


def texts_without_recurring_lines(rows, similarity=0.8, depth=3, min_docs=3):
    """The operator's rule, line by line and pair by pair."""

    def parsed(line):
        found = re.findall("[^\x20\x09-\x0d]+", line)
        if not found:
            return None
        if len(found) < 3:
            whole = " ".join(found)
            return ("short", len(found)), whole, 20 if len(whole) >= 100 else 3 if len(whole) >= 20 else len(found), None
        masked = ["#" if re.search(r"\d", w) else w for w in found]
        fixed = masked.count("#") <= (1 - similarity) * len(found)
        return (len(found), *masked[:depth]), tuple(masked if fixed else found), len(found), masked if fixed and len(found) >= 5 else None

    enough = lambda n: 2 if n >= 20 else min_docs if n >= 3 else 10
    holders, of = {}, {}
    for r, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if p := parsed(line):
                holders.setdefault(p[:2], set()).add(r)
                of[p[:2]] = p
    alike = {a: {a} for a in of}
    for a in of:
        for b in of:
            x, y = of[a][3], of[b][3]
            if a != b and a[0] == b[0] and x and y and sum(v == w != "#" for v, w in zip(x, y)) >= similarity * len(x) - 1e-9:
                alike[a].add(b)
    gone = {}
    for a in of:
        group, todo = {a}, [a]
        while todo:
            new = alike[todo.pop()] - group
            group |= new
            todo += new
        docs = set().union(*(holders[b] for b in group))
        keys = [rows[r][0] for r in docs if rows[r][0] is not None]
        if len(docs) >= enough(of[a][2]) and keys:
            gone[a] = min(keys)
    lost = lambda i, line: i is not None and (p := parsed(line)) and p[:2] in gone and gone[p[:2]] != i
    return [(i, t if t is None else "\n".join(s for s in t.split("\n") if not lost(i, s))) for i, t in rows]


@pytest.mark.parametrize("seed, tile", [(0, 512), (1, 512), (2, 3), (3, 3), (4, 8), (5, 2)])
def test_lines_against_plain_python(documents, seed, tile):
    r = random.Random(seed)
    word = lambda: r.choice(["p", "q", "r", "s", "t", "4", "x9"]) if r.random() < 0.9 else prose(r, 1)
    stems = [[word() for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 16, 24]))] for _ in range(25)]

    def line():
        stem = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            stem[r.randrange(len(stem))] = word()
        return " ".join(stem)

    rows = [(r.choice([None, i, i, i, r.randrange(60)]), r.choice([None, "", *["\n".join(line() for _ in range(r.randrange(1, 9)))] * 18])) for i in range(60)]
    got = line_templates.drop_recurring_lines(documents(rows), tile=tile).collect()
    want = texts_without_recurring_lines(rows)
    assert Counter((x.doc_id, x.text) for x in got) == Counter(want)
    assert sum(a != b for a, b in zip(rows, want)) >= 10


def test_lines_count_documents(documents):
    """Two lines of a template in one document and one in another are two documents; a line in three documents and two
    versions in one each are five."""
    opened = lambda who: f"Session opened for user {who} on host alpha just now"
    rows = [(1, f"{opened('ann')}\n{opened('bob')}"), (2, opened("cy"))]
    assert [x.n_dropped for x in line_templates.drop_recurring_lines(documents(rows)).collect()] == [0, 0]
    rows = [(i, opened("ann") + f"\nown{i}") for i in (1, 2, 3)] + [(4, opened("bob")), (5, opened("cy")), (None, opened("ann"))]
    assert {x.doc_id: x.n_dropped for x in line_templates.drop_recurring_lines(documents(rows)).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, None: 0}
    rows = [(None, opened("ann")), (None, opened("bob")), (7, opened("cy")), (8, opened("di"))]
    assert {x.doc_id: x.n_dropped for x in line_templates.drop_recurring_lines(documents(rows)).collect() if x.doc_id} == {7: 0, 8: 1}


def test_signatures():
    r = random.Random(4)
    for _ in range(300):
        n = r.choice([5, 6, 8, 10, 13, 20, 31])
        a = [r.choice([*range(6), line_templates.FIELD_CODE]) if r.random() < 0.2 else k for k in range(n)]
        b = [r.choice([*range(6), line_templates.FIELD_CODE]) if r.random() < 0.2 else k for k in range(n)]
        b[:3] = a[:3]
        if a == b:
            continue
        (sure, x), (_, y) = line_templates.signatures(a, 3, 0.8), line_templates.signatures(b, 3, 0.8)
        alike = sum(v == w != line_templates.FIELD_CODE for v, w in zip(a, b)) >= 0.8 * n - 1e-9
        assert not alike or set(x) & set(y)
        assert alike or not sure or not set(x) & set(y)


def test_lines_verbatim_with_digits(documents):
    dated, row = "Published 12 March 2021", "7 | 8 | 9 | 10"
    rows = [(i, f"{dated}\n{row}\nPublished {i} March {i + 1990}\n{i} | 1{i} | 2{i} | 3{i}") for i in range(3)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].text == "\n".join(rows[i][1].split("\n")[2:]) for i in (1, 2))


def test_lines_long_in_two_documents(documents):
    words, short = prose(random.Random(13), 60).split(), prose(random.Random(14), 19)
    passage, other = edited(words), edited(words, 9, 30)
    twenty = prose(random.Random(15), 20)
    rows = [(1, f"{passage}\n{short}\n{twenty}"), (2, f"own line\n{short}\n{passage}"), (3, f"{twenty}\n{prose(random.Random(16), 60)}"), (4, f"{prose(random.Random(17), 45)}\na b c")]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == [rows[0][1], f"own line\n{short}", rows[2][1].split("\n")[1], rows[3][1]]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents([(1, passage), (2, other)])).collect()}
    assert got[1].text == passage and got[2].text == ""


def test_lines_of_few_tokens(documents):
    some, many = "\u6587" * 20, "\u5b57" * 100
    rows = [(i, "\n".join(["Read more", *([some, "\u7248\u6743"] if i < 3 else []), *([many] if i < 2 else []), *(["Les."] if i < 9 else []), f"own{i}"])) for i in range(10)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(documents(rows)).collect()}
    assert got[0].text == rows[0][1]
    assert got[1].text == got[2].text.replace("own2", "own1") == "\u7248\u6743\nLes.\nown1"
    assert got[8].text == "Les.\nown8" and got[9].text == "own9"


def labelled_corpus(n=240):
    r = random.Random(6)
    rows, quality_, toxic = [], {}, {}
    for i in range(n):
        text = prose(r, r.randint(20, 120))
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            words = text.split()
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["zyxxor", "quivvet", "vrompuz"])
            text = " ".join(words)
        quality_[i] = int(i % 5 != 0)
        rows.append((i, text if quality_[i] else text.replace(" ", "### ")))
    return rows, quality_, toxic


@pytest.fixture(scope="module")
def judged(spark, documents):
    rows, quality_, toxic = labelled_corpus()
    extra = [(1000, None), (1001, ""), (1002, "x"), (1003, rows[0][1]), (1003, rows[0][1]), (1004, "word " * 50_000), (None, rows[0][1])]
    labels = spark.createDataFrame([(i, quality_[i], toxic[i], "x") for i in quality_] + [(5, None, 9, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    return documents([*rows, *extra]), labels, quality_, toxic


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(judged, kind):
    docs, labels, quality_, toxic = judged
    truth = quality_ if kind == "quality" else toxic
    run = (quality if kind == "quality" else toxicity).classify
    got = run(docs, labels).collect()
    import zlib

    assert len(got) == 247
    by = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if kind == "quality" else 0.3))
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        by[r.doc_id] = r
    held = [i for i in truth if by[i].held_out]
    assert len(held) > 30 and np.mean([by[i].predicted == truth[i] for i in held]) >= 0.9
    assert by[1003].score == by[0].score == by[None].score  # neither key nor order matters
    assert sorted((r.doc_id or -1, r.score) for r in run(docs.repartition(5), labels).collect()) == sorted((r.doc_id or -1, r.score) for r in got)


@pytest.mark.parametrize("run", [quality.classify, toxicity.classify])
def test_classifiers_without_labels(spark, documents, run):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, None)])
    assert len({r.score for r in run(docs, none).collect()}) == 1
    assert run(documents([]), none).count() == 0
    one_kind = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert run(docs, one_kind).count() == 2


def spark_hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(str(p).encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_against_plain_python(judged, kind):
    """The same rows learnt from and scored one by one, without Spark."""
    docs, labels, quality_, toxic = judged
    truth = quality_ if kind == "quality" else toxic
    texts = dict(labelled_corpus()[0])
    seen = sorted((spark_hash(i, kind), i) for i in truth if zlib.crc32(str(i).encode()) % 4 != 2)
    y = np.array([truth[i] for _, i in seen])
    if kind == "quality":
        model = quality.fit([quality.features(texts[i]) for _, i in seen], y, float(y.mean()))
        score = lambda t: model.score(quality.features(t))
    else:
        model = toxicity.fit([texts[i] for _, i in seen], y, float(y.mean()))
        gains = toxicity.Gains(model.toxic, model.ordinary)
        score = lambda t: model.score(gains.of(t))
    for r in (quality if kind == "quality" else toxicity).classify(docs, labels).collect():
        want = {1000: "", 1001: "", 1002: "x", 1003: texts[0], 1004: "word " * 50_000, None: texts[0]}.get(r.doc_id, texts.get(r.doc_id))
        assert r.score == pytest.approx(score(want), abs=1e-9)


def test_training_rows_are_bounded(spark, documents):
    docs = documents([(i, "y" * (i + 1)) for i in range(40)] + [(3, "other")] * 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 0), (8, None)], "doc_id long, quality int")
    rows = labelled.training_rows(docs, labels, "quality", (6, 9)).collect()
    assert Counter(r.label for r in rows)[0] <= 6 and Counter(r.label for r in rows)[1] <= 9 and len({r._h for r in rows}) == len(rows) > 5
    everything = labelled.training_rows(docs, labels, "quality", (100, 100)).collect()
    assert len(everything) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    few = labelled.training_rows(docs, labels, "quality", (100, 100), most_bytes=90).collect()
    for y in (0, 1):
        queue = [r.text for r in sorted(everything, key=lambda r: r._h) if r.label == y]
        left, fits = 90, []
        for t in queue:
            if len(t) <= left:
                left -= len(t)
                fits.append(t)
        assert sorted(r.text for r in few if r.label == y) == sorted(fits)
    assert labelled.training_rows(documents([]), labels, "quality", (5, 5)).count() == 0


def test_training_passes_over_long_texts(spark, documents, caplog):
    """However long the first text of each label is, the others are learnt from; if all are too long, that is logged."""
    docs = documents([(i, ("good words here " if i % 2 else "bad stuff there ") * 4 + str(i)) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = sorted(labelled.training_rows(docs, labels, "quality", (99, 99)).collect(), key=lambda r: r._h)
    first = {y: next(r.text for r in rows if r.label == y) for y in (0, 1)}
    long = docs.withColumn("text", F.when(F.col("text").isin(*first.values()), F.repeat("text", F.lit(50))).otherwise(F.col("text")))
    got = labelled.training_rows(long, labels, "quality", (99, 99), most_bytes=2_500).collect()
    assert len(got) == len(rows) - 2 and {r.label for r in got} == {0, 1}
    scores = {r.doc_id: r.score for r in quality.classify(long, labels, most_bytes=2_500).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))
    assert labelled.training_rows(docs, labels, "quality", (99, 99), most_bytes=10).count() == 0 and "nothing to learn from" in caplog.text


def test_memory_of_training():
    """4,000 texts of as many features as the bound allows: the descent keeps nothing of their size beside them."""
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, quality.DIM, 2_000)).astype(np.int32) for _ in range(2_000)]
    held = sum(r.nbytes for r in rows)
    labels = np.arange(len(rows)) % 2
    tracemalloc.start()
    quality.dual_coordinate_descent(rows, quality.Scaled(rows, quality.log_count_ratio(rows, labels)), labels, epochs=2)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < held / 2 and 32 * quality.MOST_BYTES < 500e6


def test_keep_good(judged):
    docs, labels, quality_, _ = judged
    good = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, p in good.items() if p}


def test_dual_coordinate_descent():
    r = np.random.default_rng(3)
    x = [np.unique(r.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    y = np.array([int(3 in v or 7 in v) for v in x])
    values = [np.ones(len(v)) for v in x]
    w, b = quality.dual_coordinate_descent(x, values, y, cost=1.0, epochs=2000)
    sign = np.where(y == 1, 1, -1)

    def loss(w, b):
        return w @ w / 2 + b * b / 2 + sum(max(0, 1 - s * (w[v].sum() + b)) for v, s in zip(x, sign))

    least = loss(w, b)
    for _ in range(200):  # no step helps by more than the stopping rule leaves
        step = np.zeros_like(w)
        step[:30] = r.standard_normal(30) * 10.0 ** r.uniform(-4, 0)
        assert loss(w + step, b + r.standard_normal() * 1e-3) >= least * 0.99


def test_logistic():
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 1))
    y = (r.uniform(size=4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(int)
    a, b = labelled.logistic(x, y)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2


def test_windows():
    for n in (0, 1, 16, 128, 129, 240, 241, 5000):
        b = bytes(i % 251 for i in range(n))
        parts = list(toxicity.windows(b))
        assert parts[0] + b"".join(p[toxicity.OVERLAP :] for p in parts[1:]) == b
