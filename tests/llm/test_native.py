import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fernglass.llm import common, graph, mixing, packing, sharding, urls

MESSY = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "é " * 50, "y"), (5, "a b c", None), (5, "a b c", None), (None, "w", "x"), (6, "\u00a0 \t x\n", "z"), (7, "long " * 20_000, "y")]


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7).alias("o"), "id").repartition(7)
    got = defaultdict(list)
    for r in common.running_before(df, ["g"], ["o", "id"], F.col("id"), "b").collect():
        got[r.g].append(((r.o is not None, r.o or 0, r.id), r.id, r.b))
    for rows in got.values():
        total = 0
        for _, i, b in sorted(rows):
            assert b == total
            total += i


def test_global_index(spark):
    rows = common.global_index(spark.range(100).repartition(5).select((99 - F.col("id")).alias("k")), [F.col("k")], "at").collect()
    assert all(r.at == r.k for r in rows) and len(rows) == 100


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (150, 100), (7, 7), (300, 300), (None, 5)] + [(1000, i) for i in range(900, 960)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[200] == 100 and roots[300] == 300 and roots[1000] == 900 and len(roots) == 41 + 3 + 1 + 61
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_shards(documents):
    rows = sharding.shard(documents(MESSY)).collect()
    assert len(rows) == len(MESSY)
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
    by_id = {i: t for i, t, _ in MESSY}
    for r in rows:
        t = by_id[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(documents([])).count() == 0


def test_shards_at_size(spark):
    """One more shard takes keys into itself alone, in its share; a changed weight moves keys to or from its shard alone."""
    k = F.col("id")
    weights = [1.0, 2.0, 1.0, 4.0]
    plans = {"a": weights, "more": [*weights, 2.0], "less": [1.0, 1.0, 1.0, 4.0], "gone": [1.0, 2.0, 0.0, 4.0]}
    rows = spark.range(20_000).select(*[sharding.rendezvous(k, w)["shard"].alias(n) for n, w in plans.items()]).collect()
    assert all(r.more in (r.a, 4) for r in rows) and abs(sum(r.more == 4 for r in rows) / len(rows) - 0.2) < 0.02
    assert all(r.less == r.a or r.a == 1 for r in rows) and 0 < sum(r.less != r.a for r in rows) < 0.2 * len(rows)
    assert all(r.gone == r.a or r.a == 2 for r in rows) and all(r.gone != 2 for r in rows)
    table = spark.range(3000).select(k.alias("doc_id"), F.lit("t").alias("text"))
    assert all(r.grown_shard in (r.shard, 16) for r in sharding.shard(table).collect())


def test_shard_weights(spark):
    keys = spark.range(4000).withColumn("t", F.lit("x"))
    share = lambda w: Counter(r.shard for r in keys.select(sharding.rendezvous(F.col("id"), w)["shard"].alias("shard")).collect())
    got = share([1, 3, 0, 4])
    assert got[2] == 0 and abs(got[1] / got[0] - 3) < 0.6 and abs(got[3] / got[0] - 4) < 0.8
    with pytest.raises(ValueError):
        share([0.0])


def water(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, goal = share * sum(sizes.values()), {}
    while True:
        level = left / max(sum(w for s, w in weight.items() if s not in goal), 1e-9)
        over = [s for s in order if s not in goal and weight[s] * level >= most * sizes[s]]
        if not over:
            return goal | {s: weight[s] * level for s in order if s not in goal}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        if len(goal) == len(order):
            return goal


def test_mix_targets(spark):
    sizes = {"b": 100, "a": 10, None: 30, "é": 70, "c": 0, "Z": 500}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix(documents):
    rows = mixing.mix(documents(MESSY)).collect()
    assert len(rows) == len(MESSY)
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {0} and next(r["size"] for r in rows if r.doc_id == 6) == 2
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(documents(MESSY).repartition(3)).collect()))
    assert mixing.mix(documents([])).count() == 0


def test_mix_comes_near(documents):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 4 if i % 3 else 0}") for i in range(800)]
    taken, goal = Counter(), {}
    for r in mixing.mix(documents(rows)).collect():
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 97 for s in goal)


def rate_of(sizes, target, most=2.0):
    """The rate by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most, mid * n.bit_length()) * n for n in sizes) < target else (low, mid)
    return low


def test_mix_favours(documents):
    """Inclusion grows with the digits of the size, certain copies aside; the share that is sampled follows it."""
    sizes = [3] * 600 + [200] * 300 + [2000] * 100
    got = mixing.mix(documents([(i, "w " * n, "one") for i, n in enumerate(sizes)]), share=0.4).collect()
    rate = rate_of(sizes, 0.4 * sum(sizes))
    for n in (3, 200, 2000):
        mine = [r.copies for r in got if r["size"] == n]
        assert min(mine) >= int(rate * n.bit_length()) and abs(sum(mine) / len(mine) - rate * n.bit_length()) < 0.12
    halves = mixing.mix(documents([(i, "w " * n, "one") for i, n in enumerate(sizes)]), share=0.4, favour=F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1).cast("bigint")).collect()
    picked = [sum(r.copies for r in halves if r.doc_id % 2 == k) for k in (0, 1)]
    assert 2 < picked[0] / picked[1] < 4.5


def test_sample_rate(spark):
    r = [(1, 10), (4, 300), (7, 50), (9, 5000)]
    for target in (0.0, 100.0, 4000.0, 10_000.0, 10_700.0, 10_720.0):
        strata = spark.createDataFrame([("s", target, f, w) for f, w in r], "source string, target double, favour long, words long")
        rate = mixing.sample_rate(strata).first().rate
        assert sum(min(2.0, (1e9 if rate is None else rate) * f) * w for f, w in r) == pytest.approx(target)


def test_mix_is_applied(documents):
    docs = documents([(i, "w " * 10, f"s{i % 3}") for i in range(90)])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies})


@pytest.mark.parametrize("rows", [[(None, "a b c d", "x")] * 5 + [(1, "a b", "x")], [(7, "a b c d", "x")] * 5, [(7, "one two", "x"), (7, "three four", "x"), (7, "five six", None), (None, None, "x"), (None, "", "y"), (None, "a", "y")], MESSY])
def test_mix_is_applied_by_row(documents, rows):
    """Null and repeated keys neither multiply rows nor lose them."""
    docs = documents(rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r["size"], r.source] += r.copies
    got = Counter((r.doc_id, len((r.text or "").replace("\u00a0", "x").split()), r.source) for r in mixing.mixed_documents(docs).collect())
    assert got == +want


def padding(bounds, lengths):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def least_padding(lengths, k):
    """The plain dynamic programme, in squares of the number of lengths."""
    counts = Counter(lengths)
    tops = sorted(counts)
    cost = [sum((t - tops[i]) * counts[tops[i]] for i in range(j + 1)) for j, t in enumerate(tops)]
    for _ in range(1, k):
        pad = [[sum((t - tops[m]) * counts[tops[m]] for m in range(i, j + 1)) for i in range(j + 1)] for j, t in enumerate(tops)]
        cost = [min((cost[i - 1] if i else 0) + pad[j][i] for i in range(j + 1)) for j in range(len(tops))]
    return cost[-1]


@pytest.mark.parametrize("lengths, k", [([1, 1, 2, 9, 10, 30], 3), ([5], 4), ([0, 0, 7], 1), (list(range(12)), 4), ([3, 3, 3, 8, 8, 20, 21, 22], 2)])
def test_best_bounds(lengths, k):
    counts = Counter(lengths)
    tops = sorted(counts)
    got = packing.best_bounds(tops, [counts[t] for t in tops], k)
    assert len(got) <= k and got[-1] == max(lengths)
    best = min(padding([*c, max(lengths)], lengths) for n in range(k) for c in itertools.combinations(tops[:-1], min(n, len(tops) - 1)))
    assert padding(got, lengths) == best == least_padding(lengths, k)


@pytest.mark.parametrize("seed", range(6))
def test_best_bounds_of_long_lengths(seed):
    r = random.Random(seed)
    lengths = [int(r.paretovariate(0.7 + seed / 5) * 20) % 50_000 for _ in range(90)] + [r.randrange(513, 9000) for _ in range(30 * (seed % 2))]
    counts = Counter(lengths)
    tops = sorted(counts)
    for k in (1, 2, 5, 16):
        got = packing.best_bounds(tops, [counts[t] for t in tops], k)
        assert padding(got, lengths) == least_padding(lengths, k)


def test_pack_long(documents):
    """Whole plan against brute force, with lengths far above 512."""
    r = random.Random(3)
    sizes = [r.choice([r.randrange(5), r.randrange(500), r.randrange(600, 5000)]) for _ in range(60)]
    got = packing.pack(documents([(i, "w " * n) for i, n in enumerate(sizes)]), buckets=6, budget=4096).collect()
    assert sum(x.bucket_len - x.n_tokens for x in got) == least_padding(sizes, 6)
    bounds = {x.bucket: x.bucket_len for x in got}
    for b, top in bounds.items():
        mine = sorted((common_unit(x.doc_id, "pack"), x.doc_id, x.batch, x.slot) for x in got if x.bucket == b)
        per = max(1, 4096 // max(top, 1))
        assert [(x[2], x[3]) for x in mine] == [(n // per, n % per) for n in range(len(mine))] and top == max(x.n_tokens for x in got if x.bucket == b)


def common_unit(*parts):
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[: common.HASH_DIGITS], 16) + 0.5) / common.HASH_RANGE


def test_pack(documents):
    rows = packing.pack(documents(MESSY), buckets=3, budget=100).collect()
    assert len(rows) == len(MESSY)
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches[r.bucket, r.batch].append(r)
    for group in batches.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
        assert len(group) == 1 or len(group) * group[0].bucket_len <= 100
    assert packing.pack(documents([])).count() == 0


RULED = [
    ("http://a.net/x", "block", "net/"), ("http://a.net", "allow", None), ("http://www.Example.NET/en/1?q", "allow", "example.net/en/"), ("http://notexample.net/en/", "block", "net/"),
    ("https://m.example.com/de/#f", "block", "example.com/de/"), ("https://example.com/fr/", "allow", None), ("http://x.org/fr/1", "allow", "org/fr/"), ("nothing", "allow", None), (None, "allow", None),
    ("x://", "allow", None), ("http://NET?/", "allow", None), ("", "allow", None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, (u, _, _) in enumerate(RULED)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    assert [(got[i].verdict, got[i].rule) for i in range(len(RULED))] == [(v, r) for _, v, r in RULED]
    assert got[2].host == "www.example.net" and got[2].path == "/en/1" and got[8].host == "" and got[7].path == ""


def test_url_aliases(spark):
    canonical = '<head><LINK href="{}" rel="canonical"></head>'
    refresh = "<meta http-equiv='Refresh' content='0; URL={}'>"
    pages = [
        (0, "http://a.com/1", canonical.format("http://b.net/x")),  # to a blocked URL that is no page
        (1, "http://c.com/1", refresh.format("HTTP://A.com/1#top")),  # to the one before
        (2, "http://c.com/2", canonical.format("/1")),  # relative
        (3, "http://d.org/fr/1", canonical.format("http://c.com/2")),  # allowed by its own rule
        (4, "http://e.com/1", canonical.format("//f.com/1")),  # no block in its class
        (5, "http://e.com/1", "<link rel=stylesheet href=http://b.net/x>"),
        (6, None, canonical.format("http://b.net/x")),
        (7, "http://g.com/a/b", canonical.format("c")),
        (8, "http://g.com/a/c", refresh.format("http://example.com/de/9")),
    ]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(9)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert got[0].alias_of == got[3].alias_of == "http://a.com/1" and got[6].alias_of is None
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_extremes(spark, documents):
    """Very long URLs and pages, repeated rows, and columns with the operator's own names."""
    long_url, link = "http://a.com/" + "x" * 50_000, '<link rel="canonical" href="{}">'
    pages = [
        (1, long_url, "<p>" * 200_000 + link.format("http://b.net/" + "y" * 50_000)), (2, long_url + "#f", None), (2, long_url + "#f", None), (3, "http://c.org/", "<link " + "rel " * 50_000), (None, "http://d.net/", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("host", "path", "rule", "verdict", "alias_of", "node", "root", "a", "b", "_u", "_n", "_r", "to", "tag")})
    got = urls.filter_urls(df).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "block"), (1, "block"), (2, "block"), (2, "block"), (3, "allow")]


def test_targets_of_nothing(spark):
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0
    assert common.global_index(spark.range(0), [F.col("id")], "at").count() == 0
    assert [r.target for r in mixing.targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, source_size long")).collect()] == [0, 0]


def test_small_batches(spark):
    """A table of long texts goes to Python in batches of bounded bytes."""
    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1000b")
        assert common.small_batches(spark.range(1)).sparkSession.conf.get(name) == "1000b"
        spark.conf.unset(name)
        df = common.small_batches(spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("t")))
        sizes = [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()]
        assert sum(sizes) > 2000 * 10_000 and max(sizes) < 1.5 * common.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
