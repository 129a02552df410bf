import numpy as np
import pytest
from pyspark.sql import functions as F

from fernglass.llm import near_vectors, neighbours


def clusters(seed=1, d=12):
    random = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = random.standard_normal(d)
        rows += [centre + random.standard_normal(d) * s for s in random.uniform(0, 0.5, 12)]
    rows += [rows[0].copy(), rows[0].copy(), rows[5] * 3]
    return [[float(np.float32(x)) for x in r] for r in rows]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, id string, n int")


BAD = [(1000, None), (1001, [0.0] * 12), (1002, [1.0] * 11 + [None]), (1003, [float("nan")] + [1.0] * 11), (1004, [float("inf")] + [1.0] * 11), (1005, []), (1006, [1.0, 2.0])]


@pytest.mark.parametrize("tile", [7, 16384])
def test_near_vectors(spark, tile):
    rows = list(enumerate(clusters()))
    got = near_vectors.near_vectors(frame(spark, [*rows, *BAD, (None, [1.0] * 12)]), threshold=0.9, width=4, tile=tile).collect()
    assert len(got) == len(rows) + len(BAD) + 1
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], *(root[near[i]] if near[i].any() else [root[i]])) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    by = {r.vec_id: r for r in got}
    for i in range(len(x)):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (near[i].sum(), root[i], root[i] == i)
    for i, _ in BAD:
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[None].kept is False and by[None].component_id is None
    assert 0 < near.sum() < len(x) ** 2 / 4


def test_near_vectors_edges(spark):
    assert near_vectors.near_vectors(frame(spark, [])).count() == 0
    same = near_vectors.near_vectors(frame(spark, [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (3, [0.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in same) == [(3, 1, 3), (3, 1, 3), (3, 1, 3), (4, 1, 3)]


@pytest.mark.parametrize("tile, step", [(40, 8), (16384, 512)])
def test_nearest(spark, tile, step):
    rows = list(enumerate(clusters(2)))
    df = frame(spark, [*rows, *BAD, (None, [1.0] * 12)])
    got = neighbours.nearest(df, F.col("id") % 5 == 0, k=5, tile=tile, least_tile=tile, step=step).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hits = n = 0
    for q in range(0, len(x), 5):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - s[q, r.vec_id]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.argsort(-s[q])[:5]))
        n += 5
    assert hits / n >= 0.95
    assert {r.query_id for r in got} == set(range(0, len(x), 5))


def test_nearest_edges(spark):
    assert neighbours.nearest(frame(spark, []), F.col("id") % 5 == 0).count() == 0
    few = neighbours.nearest(frame(spark, [(0, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [-1.0, 0.0])]), F.col("id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in few] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, -1.0)]
    twins = neighbours.nearest(frame(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (None, [1.0, 0.0]), (1, None)]), F.col("id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in twins] == [(0, 1, 0, 0.0)] * 2  # rows of one key are candidates for each other


def test_collisions_choose():
    """On vectors without structure: the recall, and that few rows beyond the nearest are verified."""
    random = np.random.default_rng(5)
    x = random.standard_normal((3000, 48))
    ids = np.arange(len(x))
    made = neighbours.Tile(ids, ids, x, 5, 2, 1.4, 0.9, 1.05)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[:150] @ u.T
    s[ids[:150], ids[:150]] = -2
    found = {c: rows for c, rows, _ in made.search(ids[:150], x[:150])}
    assert np.mean([len(set(found[c]) & set(np.argsort(-s[c])[:5])) / 5 for c in found]) >= 0.95
    low, high = made.windows(u[:150] @ made.turn, made.levels[0])
    counts = np.stack([made.collisions(a, b) for a, b in zip(low, high)])
    plain = (np.abs((u @ made.turn)[None] - (u[:150] @ made.turn)[:, None]) <= 1.4 * made.levels[0] / np.sqrt(48)).sum(axis=2)
    assert (counts == plain).all() and (counts >= made.need).mean() < 0.25


def test_unit_of_near_copies():
    """2,048 near but unequal vectors in one unit: all links, in bounded memory."""
    import tracemalloc

    import pyarrow as pa

    random = np.random.default_rng(2)
    x = random.standard_normal(64) + random.standard_normal((2048, 64)) * 0.05
    turned = (x / np.linalg.norm(x, axis=1)[:, None] @ near_vectors.rotation(64)).astype(np.float32)
    rows = pa.table({"uid": np.arange(2048), "n": np.ones(2048, np.int64), "side": np.ones(2048, np.int32), "vec": [v.tobytes() for v in x], "turned": [v.tobytes() for v in turned]})
    links = np.zeros(2048, np.int64)
    tracemalloc.start()
    for k in range(4):
        got = near_vectors._verify(0.9, 16)((pa.scalar(64), pa.scalar(k)), rows)
        links[got["uid"].to_numpy()] += got["links"].to_numpy()
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert (links == 2047).all()


def test_arithmetic_of_blocks():
    """Vectors without structure: the pairs that blocks look at, by their width, cost no more than all whole pairs."""
    random = np.random.default_rng(3)
    x = random.standard_normal((2000, 64))
    turned = x / np.linalg.norm(x, axis=1)[:, None] @ near_vectors.rotation(64)
    edges, limits = near_vectors.block_edges(64, 16), near_vectors.budgets(64, 16, 0.9)
    work = candidates = 0
    for k, limit in enumerate(limits):
        slab = np.floor(turned[:, edges[k]] / np.sqrt(limit))
        n = np.array([(slab == s).sum() for s in range(int(slab.min()), int(slab.max()) + 2)])
        work += (edges[k + 1] - edges[k]) * (n @ (n - 1) / 2 + n[:-1] @ n[1:])
        candidates += sum(len(i) for i, _ in near_vectors._close(turned[:, edges[k] : edges[k + 1]], np.ones(2000, int), limit))
    assert work <= 64 * 2000 * 1999 / 2 and candidates < 1e-4 * 2000 * 1999 / 2
