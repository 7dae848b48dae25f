import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import packing

ODD = ["", "a", " a", "a ", "a  b", "a\n b", "a\n\n b", "\n", " \n x", "don't 12 é漢😀", "x<|endoftext|>y", "a\x85b", "tab\tb c", "A B  ", "  ", "　x y"]


def test_encoder_is_the_tokenizer():
    e, r = packing.encoder(), random.Random(1)
    parts = ["a", "the", " ", " ", "\n", "\t", "'s", "1", "é", "  ", "\xa0", "\x1c", ".", "<|endoftext|>", "😀", "漢", "\r\n", "\x00"]
    for t in ODD + ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(1500)]:
        assert e(t) == e.exact(t).tobytes(), repr(t)


def test_pieces_hold_every_token_once(docs, words):
    rows = [(i, words(40 + i * 13 % 700)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, None), (None, "no id"), (201, words(30_000)), (7, words(9)), (7, words(9))]
    out = packing.packed(docs(rows, extra=("ids", "n", "row", "shard")), shard_tokens=40_000).collect()
    e = packing.encoder()
    want = sorted((e(t or "") + b"\x01\x00", -1 if i is None else i) for i, t in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    for i, pieces in by_doc.items():
        if i != 7:
            pieces.sort(key=lambda r: r.start)
            ids = b"".join(np.frombuffer(r.ids, "<u4").astype("<u2").tobytes() for r in pieces)
            assert (ids, -1 if i is None else i) in want and pieces[0].doc_tokens == len(ids) // 2
            assert [r.start for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    assert sum(r.length for r in out) == sum(len(t) // 2 for t, _ in want)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        n = sum(r.length for r in pieces)
        assert n <= 2048 and n & (n - 1) == 0
    assert len({s >> 32 for s in by_seq}) > 1


def test_neighbours_against_brute_force():
    r = np.random.default_rng(2)
    tails = [r.zipf(1.3, 80).clip(0, 999).astype("<u2") for _ in range(40)]
    df = np.zeros(1 << 16, np.int64)
    for t in tails:
        df[np.unique(t)] += 1
    idf = np.log1p((40 - df + 0.5) / (df + 0.5))
    index = packing.Index(tails, idf, 80.0)
    terms = sorted(set(tails[3].tolist()))
    unused = np.ones(40, bool)
    unused[[3, *range(5, 30)]] = False
    score = {}
    for i in range(40):
        if unused[i]:
            s = sum(idf[t] * (n := int((tails[i] == t).sum())) * 2.2 / (n + 1.2) for t in terms)
            if s:
                score[i] = s
    got = index.neighbours(3, unused)
    assert set(got.tolist()) == set(score)
    ranked = [score[i] for i in got.tolist()]
    assert all(a >= b - 1e-4 for a, b in zip(ranked, ranked[1:]))


def test_counts_against_counter():
    from collections import Counter

    r = np.random.default_rng(1)
    rows = [r.integers(0, 9, r.integers(1, 30)).astype("<u2") for _ in range(20)]
    want = [(i, t, n) for i, x in enumerate(rows) for t, n in sorted(Counter(x.tolist()).items())]
    assert list(zip(*(x.tolist() for x in packing.counted(rows)))) == want


def test_windows_against_a_plain_greedy_rule():
    """Every seed's window: all neighbours by score that fit whole, then the best left is cut."""
    r = np.random.default_rng(6)
    tails = [r.zipf(1.3, r.integers(1, 120)).clip(0, 999).astype("<u2") for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=1 << 16)
    idf = np.log1p((60 - df + 0.5) / (df + 0.5))
    start, out, window = [0] * 60, [], 256
    full = [i for i, t in enumerate(tails) if len(t) >= window]
    assert not full
    while any(start[i] < len(t) for i, t in enumerate(tails)):
        seed = next(i for i, t in enumerate(tails) if start[i] < len(t))
        row = [(seed, start[seed], len(tails[seed]) - start[seed])]
        start[seed] = len(tails[seed])
        score = lambda i: sum(idf[t] * (n := int((tails[i] == t).sum())) * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(tails[i]) / 60.0)) for t in set(tails[seed].tolist()) & set(tails[i].tolist()))
        near = sorted((i for i in range(60) if start[i] < len(tails[i]) and score(i)), key=lambda i: (-round(score(i), 9), i))
        for i in near:
            if len(tails[i]) - start[i] <= window - sum(n for *_, n in row):
                row.append((i, start[i], len(tails[i]) - start[i]))
                start[i] = len(tails[i])
        for i in near + list(range(seed, 60)):
            n = min(window - sum(n for *_, n in row), len(tails[i]) - start[i])
            if n:
                row.append((i, start[i], n))
                start[i] += n
        out.append(row)
    got = packing.pack(tails, idf, 60.0, window)
    assert len(out) > 10 and got[: len(out) - 1] == out[:-1]


def test_topics_lie_together_and_large_ones_are_split(spark):
    rows = [(i, i, 100, 7 if i % 3 else 1000 + i, b"") for i in range(3000)]
    tokens = spark.createDataFrame(rows, "doc_id long, row long, n long, topic int, ids binary")
    spread, n, total = packing.sharded(tokens, 10_000)
    shards = {r.shard: r.n for r in spread.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert (n, total) == (3000, 300_000) and len(shards) == 30 and max(shards.values()) < 15_000
    seven = {r.shard for r in spread.where("topic = 7").select("shard").distinct().collect()}
    assert len(seven) == 20 and packing.topics([np.array([5, 900, 900, 5, 5, 1]), np.array([3]), np.array([9, 8, 8, 9, 9])]) == [900, 3, 9]


def test_like_goes_with_like():
    """Two topics, interleaved: windows hold one topic."""
    r = np.random.default_rng(3)
    tails = [(r.integers(0, 300, 500) + 5000 * (i % 2)).astype("<u2") for i in range(40)]
    df = np.zeros(1 << 16, np.int64)
    for t in tails:
        df[np.unique(t)] += 1
    sequences = packing.pack(tails, np.log1p((40 - df + 0.5) / (df + 0.5)), 500.0)
    pure = [len({i % 2 for i, _, _ in s}) == 1 for s in sequences if len(s) > 2]
    assert sum(pure) >= 0.8 * len(pure)


def test_op1(docs):
    out = packing.op1(docs([(1, "one two"), (2, None)])).collect()
    ids = np.concatenate([np.frombuffer(packing.encoder()("one two"), "<u2"), [1]]).astype("<u4").tobytes()
    pieces = sorted((r for r in out if r.doc_id == 1), key=lambda r: r.start)
    assert sum(r.length for r in pieces) == len(ids) // 4
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    assert packing.op1(docs([])).count() == 0


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 5000])
def test_lengths_at_the_window(n):
    got = packing.pack([np.arange(n).astype("<u2")], np.ones(1 << 16), 1.0)
    assert sum(k for s in got for _, _, k in s) == n
