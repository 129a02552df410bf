import hashlib
import random
import zlib

import numpy as np
import pytest

from fernglass.llm import periodic_runs, queries



def plain_runs(words, least=6, power=4):
    """Every period, every stretch."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    lost = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in lost)


def made(random_, least=6, power=4):
    words = [random_.randrange(random_.choice([1, 2, 3, 5])) for _ in range(random_.randint(0, 40))]
    for _ in range(random_.randint(0, 3)):
        part = [random_.randrange(4) for _ in range(random_.randint(1, 9))]
        words += (part * 9)[: random_.randint(4, 60)] + [random_.randrange(9) for _ in range(random_.randint(0, 5))]
    return [f"w{w}" for w in words]


@pytest.mark.parametrize(("least", "power"), [(6, 4), (2, 2), (4, 3), (9, 2), (12, 5)])
def test_runs_against_every_period(least, power):
    random_ = random.Random(least * 10 + power)
    for _ in range(500):
        words = made(random_)
        assert [tuple(map(int, r)) for r in periodic_runs.word_runs(words, least, power)] == plain_runs(words, least, power), words


def test_masking():
    """Words outside repeated 5-grams are out before runs are looked for; a word alone among 10,000 others is."""
    assert periodic_runs.overlap() == 5 and periodic_runs.overlap(2, 2) == 1 and periodic_runs.overlap(30, 4) == 23
    with pytest.raises(ValueError):
        periodic_runs.overlap(6, 1)
    codes = np.concatenate([np.arange(10_000), np.tile([1, 2, 3], 8), np.arange(20_000, 30_000)])
    ((start, end),) = periodic_runs.segments(codes, 5)
    # the run's first two words are a neighbour's, too: 1 2 3 stands in the rising numbers, but no 5-gram of it
    assert (start, end) == (10_000, 10_024)
    assert periodic_runs.segments(np.arange(500), 5) == [] and periodic_runs.segments(np.array([1, 1, 1]), 5) == []


def test_long_runs():
    """A hundred thousand equal words, and a period of thousands: not the square of them."""
    assert periodic_runs.word_runs(["a"] * 100_000).tolist() == [[0, 100_000, 1]]
    words = [f"{i % 7_919}" for i in range(80_000)]
    assert periodic_runs.word_runs(["x", *words, "y"]).tolist() == [[1, 80_000, 7_919]]


def test_rows(spark, documents):
    rows = [(1, "a b " * 6 + "c"), (2, None), (3, ""), (4, " \n\t "), (5, "x y " * 7), (5, "x y " * 7), (None, "q " * 5), (6, "long " * 50_000), (7, "é\x0bé\x0cé\ré\té\né z")]
    got = {}
    for r in periodic_runs.find_runs(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.n_words, r.text))
    assert got[1] == [([(0, 12, 2)], 13, "a b c")] and got[2] == [([], 0, None)] and got[3] == got[4] == [([], 0, "")]
    assert got[5] == [([(0, 7, 1)], 7, "x y")] * 2 and got[None] == [([], 5, "q q q q q")]
    assert got[6] == [([(0, 50_000, 1)], 50_000, "long")] and got[7] == [([(0, 6, 1)], 7, "é z")]
    assert periodic_runs.find_runs(documents([])).count() == 0
    keyed = spark.createDataFrame([("k", "a " * 9)], "_key string, runs string")
    assert [tuple(r) for r in periodic_runs.find_runs(keyed, "_key", "runs").collect()] == [("k", 9, [(0, 9, 1)], "a")]


def test_query_against_plain_python(spark, tmp_path):
    """The planted repeats, the digests and the longest run, each made again."""
    random_ = random.Random(5)
    rows = [(i, " ".join(made(random_) + [str(random_.random()) for _ in range(random_.choice([0, 3, 60]))])) for i in range(400)] + [(900, None), (901, ""), (902, "one"), (None, "a " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for i, t in rows:
        words = (t or "").split()
        h = 1 if i is None else zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            planted += 1
        runs, r = plain_runs(words), got[i]
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)) and r.collapsed_sha256 == sha(plain_collapsed(words, runs))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 10 and got[900].collapsed_sha256 == sha("")
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(empty / "documents.parquet"))
    assert queries.op13_periodic_runs(spark, str(empty)).count() == 0


def test_query_types(spark):
    types = dict(queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").dtypes)
    assert {types[c] for c in ("n_runs", "start", "length", "period", "exponent_milli")} == {"bigint"}
