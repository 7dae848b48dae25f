import random
from collections import Counter

import xxhash

from weftline.llm import simhash


def brute_fingerprint(text):
    import re

    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(items):
    """items: (id, fp); id -> least id reachable."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in items:
        for j, g in items:
            if i < j and (f ^ g).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in items}


def test_fingerprints(words):
    texts = [None, "", " \t\n", "One", "one TWO", "One two three", "É È Ñ a b", "a\x85b c d", "a\x1cb c d", words(5000), "x y z x y z x y z", "tie a", "\x0b\x0cq w e r"] + [words(k) for k in range(40)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), repr(t)


def test_links_give_the_components_of_all_pairs(spark):
    r = random.Random(3)
    fps = [0, 2**64 - 1]
    for _ in range(40):
        c = r.getrandbits(64)
        fps.append(c)
        for _ in range(r.randint(0, 6)):
            x = c
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.append(x)
            c = r.choice([c, x])
    base = r.getrandbits(64)
    fps += [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]  # a crowd in one half
    fps += [base ^ (1 << 40) ^ (7 << 33 + 3 * k) for k in range(3)]
    fps = list(dict.fromkeys(fps))
    items = list(enumerate(fps))
    want = brute_components(items)
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in items]
    df = spark.createDataFrame(signed, "i long, fp long")
    edges = simhash.links(df)
    by_shuffle = {tuple(sorted((x.a, x.b))) for x in simhash.links(df, near=0, hot=50).collect()}
    assert by_shuffle == {tuple(sorted((x.a, x.b))) for x in edges.collect()}
    back = {f: i for i, f in signed}
    got = {i: i for i, _ in items}
    from weftline.llm.graph import components

    groups: dict = {}
    for row in components(edges).collect():
        groups.setdefault(row.root, []).append(back[row.node])
    for members in groups.values():
        for m in members:
            got[m] = min(members)
    assert got == want
    assert max(Counter(want.values()).values()) > 20


def test_op7_whole(docs, words):
    a, b = words(300), words(300)
    near = a.split()
    near[100] = "changed"
    rows = [(5, a), (3, a), (9, " ".join(near)), (4, b), (7, None), (8, ""), (6, "  "), (None, a), (4, b), (11, words(200_000))]
    out = simhash.op7(docs(rows, extra=("fp", "component_id", "fingerprint", "root", "least", "key"))).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    got = {r.doc_id: r for r in out}
    known = [(i, brute_fingerprint(t)) for i, t in dict((r[0], r[1]) for r in rows if r[0] is not None).items()]
    want = brute_components(known)
    assert {i: got[i].component_id for i, _ in known} == want
    assert {i: got[i].fingerprint for i, _ in known} == {i: f"{f:016x}" for i, f in known}
    assert got[None].component_id is None and got[7].component_id == 6
    assert simhash.op7(docs([])).count() == 0
