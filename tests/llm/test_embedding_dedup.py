import numpy as np

from weftline.llm import embedding_dedup as x

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {}
    for a, (i, u) in enumerate(ok):
        for b, (j, v) in enumerate(ok):
            if a < b and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.9:
                links.setdefault(a, []).append(b)
                links.setdefault(b, []).append(a)
    n = [(i, len(links.get(a, []))) for a, (i, _) in enumerate(ok)]
    root = list(range(len(ok)))
    for _ in range(len(ok)):
        new = [min([root[a]] + [root[b] for b in links.get(a, [])]) for a in range(len(ok))]
        if new == root:
            break
        root = new
    least = {}
    for a, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), ok[a][0])
    return sorted((i, k, least[root[a]]) for a, (i, k) in enumerate(n))


def make(seed=0, n=300, dim=16):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(n // 6):
        centre = r.normal(size=dim)
        for _ in range(r.integers(1, 12)):
            rows.append((len(rows), (centre + r.normal(size=dim) * r.uniform(0, 0.35)).tolist()))
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return x.op9(df).collect()


def test_recall_and_precision(spark):
    rows = make()
    want = {i: (k, c) for i, k, c in brute(rows)}
    got = {r.vec_id: r for r in run(spark, rows)}
    assert set(got) == set(want)
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(k for k, _ in want.values()) > 0
    assert np.mean([got[i].component_id == want[i][1] for i in want]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_blocks_of_long_lists_give_the_same(spark, monkeypatch):
    rows = make(3, 120)
    one = sorted(map(tuple, run(spark, rows)))
    monkeypatch.setattr(x, "BLOCK", 20)
    assert sorted(map(tuple, run(spark, rows))) == one


def test_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.0]), (4, [2.0, 0.01]), (1, [0.0, 0.0]), (2, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (13, [1e-30, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0])]
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in run(spark, rows))
    want = {9: (5, 3), 3: (5, 3), 5: (5, 3), 4: (5, 3), 13: (5, 3)}
    assert len(got) == len(rows)
    for i, n, c, kept in got:
        if i == -1:
            assert (n, c, kept) == (0, None, None)
        else:
            assert (n, c) == want.get(i, (0, i)) and kept == (c == i)
    assert run(spark, []) == []


def test_recall_in_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(7)
    n, dim = 21_000, 64
    v = x.unit(r.normal(size=(n, dim)))
    v[: n // 3] = x.unit(np.sqrt(0.95) * v[0] + np.sqrt(0.05) * v[: n // 3])  # cosines of 0.93 to 0.97 or so
    v = v.astype(np.float32)
    u = x.unit(v.astype(float))
    want = np.concatenate([(u[a : a + 1000] @ u.T >= x.LEAST).sum(axis=1) - 1 for a in range(0, n, 1000)])
    got = {q.vec_id: q for q in run(spark, list(enumerate(v.tolist())))}
    have = np.array([got[i].n_links for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.999 * want.sum() > 40_000_000
    assert {got[i].component_id for i in range(n // 3)} == {0}


def test_thinned_pivots():
    r = np.random.default_rng(1)
    v = x.unit(np.concatenate([r.normal(size=(300, 16)), r.normal(size=16) + r.normal(size=(700, 16)) * 0.1])[r.permutation(1000)])
    kept = x.thinned(v, 100)
    c = kept @ kept.T - np.eye(len(kept))
    assert len(kept) == 100 and c.max() < x.APART
    assert len(x.thinned(v[:0], 5)) == 0 and len(x.thinned(v[:9], 1)) == 1


def test_recall_holds_as_pivots_grow():
    r = np.random.default_rng(2)
    assert [x.places(p) for p in (16, 1024, 1025, 4096, 16_384, 65_536)] == [8, 8, 10, 10, 12, 14]
    assert x.pivot_count(10) == 16 and x.pivot_count(100_000) == 800 and x.pivot_count(10**8) == 40_000
    for pivots in (1024, 4096, 16_384):
        index = x.Pivots({}, pivots)
        a = x.unit(r.normal(size=(1500, 64)))
        o = r.normal(size=a.shape)
        o = x.unit(o - (o * a).sum(axis=1, keepdims=True) * a)
        near, other = index.nearest(a), index.nearest(0.9 * a + np.sqrt(1 - 0.81) * o)
        found = [len(np.intersect1d(p, q)) >= x.SHARED or p[0] == q[0] for p, q in zip(near, other)]
        assert np.mean(found) > 0.97, pivots
