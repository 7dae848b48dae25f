import random
import zlib

import numpy as np

from weftline.llm import toxicity as x


def rows(n, seed=1, rule=lambda a, b: a and b):
    """Toxic only if an insult meets a group (or by another rule of the two): no additive weights can tell."""
    r = random.Random(seed)
    pool = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    out = []
    for i in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = r.choices(pool, k=40) + ["insult"] * a + ["group"] * b
        r.shuffle(w)
        out.append((i, " ".join(w), int(rule(a, b))))
    return out


def test_pairs_that_linear_weights_miss(spark, docs):
    data = rows(1500)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    out = x.op4(docs([(i, t) for i, t, _ in data], extra=("score", "k", "toxic")), labels).collect()
    held = [(r, data[r.doc_id][2]) for r in out if r.held_out]
    assert len(held) > 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)


def test_pairs_whose_parts_tell_nothing(spark, docs):
    data = rows(3000, 3, lambda a, b: a != b)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    out = x.op4(docs([(i, t) for i, t, _ in data]), labels).collect()
    held = [(r, data[r.doc_id][2]) for r in out if r.held_out]
    assert len(held) > 400 and np.mean([r.predicted == y for r, y in held]) > 0.95


def test_fitted_machine_against_brute_force():
    """Scores are those of the sum over all pairs, and the fit has a lower loss than any additive one on what pairs decide."""
    data = rows(800, 5, lambda a, b: a != b)
    known, y = [x.terms(t) for _, t, _ in data], np.array([k for *_, k in data], float)
    m = x.fit_machine(known, y)
    p = np.array([m.score(t) for _, t, _ in data])
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < 0.35  # 0.69 for weights alone, were the words noise
    for _, t, _ in data[:40]:
        i = sorted({m.at[z] for z in x.terms(t).tolist() if z in m.at})
        z = m.w0 + sum(m.w[a] for a in i) + sum(m.v[a] @ m.v[b] for n, a in enumerate(i) for b in i[n + 1 :])
        assert abs(m.score(t) - 1 / (1 + np.exp(-z))) < 1e-9


def test_effects_against_brute_force():
    """What the first machine reports is, for one turn without steps, each term's share of the scores of its starting weights."""
    r = np.random.default_rng(1)
    known = [np.unique(r.integers(0, 30, 12)) for _ in range(50)]
    e = x.first_machine(known, r.integers(0, 2, 50).astype(float), 31, rate=0.0)
    v = np.random.default_rng(4).normal(0, 0.05, (4, 31))
    want = np.zeros(31)
    for t in known:
        for i in t:
            want[i] += sum(v[:, i] @ v[:, j] for j in t if j != i) ** 2
    assert np.allclose(e, np.sqrt(want)) and e[30] == 0


def test_rows_are_bounded_by_terms(spark, docs):
    data = rows(200)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    d, seen = docs([(i, t) for i, t, _ in data]), []
    real = x.fit_machine
    try:
        x.fit_machine = lambda r, y: seen.append(r) or real(r[:0], y[:0])
        for most in (10**6, 1000, 1):
            x.fit(d, labels, fit_terms=most)
    finally:
        x.fit_machine = real
    sizes = [sum(map(len, r)) for r in seen]
    assert len(seen[0]) == 200 and 900 < sizes[1] <= 1000 and len(seen[2]) == 1


def test_machine_against_all_pairs():
    r = np.random.default_rng(0)
    m = x.Machine(np.array([x.zlib.crc32(w) % x.BUCKETS for w in (b"aa", b"bb", b"cc")]), 0.3, r.normal(size=3), r.normal(size=(3, 4)))
    z = 0.3 + m.w[0] + m.w[2] + m.v[0] @ m.v[2]
    assert abs(m.score("AA zz cc aa") - 1 / (1 + np.exp(-z))) < 1e-12


def test_held_out_labels_teach_nothing(spark, docs):
    data = rows(200)
    flip = [(i, 0, (1 - y) if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in data]
    d = docs([(i, t) for i, t, _ in data])
    one = x.op4(d, spark.createDataFrame([(i, 0, y) for i, _, y in data], "doc_id long, quality int, toxic int"))
    two = x.op4(d, spark.createDataFrame(flip, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_edges(spark, docs):
    labels = "doc_id long, quality int, toxic int"
    d = docs([(1, None), (2, ""), (None, "x"), (3, "word " * 200_000), (3, "again"), (4, "bad")])
    none = x.op4(d, spark.createDataFrame([], labels)).collect()
    assert len(none) == 6 and {r.predicted for r in none} == {0}
    some = x.op4(d, spark.createDataFrame([(4, 1, 1), (4, 1, None), (None, 1, 1), (3, 1, 0), (3, 1, 0)], labels)).collect()
    assert len(some) == 6 and {r.doc_id for r in some} == {1, 2, 3, 4, None}
    assert x.op4(docs([]), spark.createDataFrame([], labels)).count() == 0
