"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the hashed terms that a text has; the
pairs let two terms together mean what neither does alone. Terms are runs of letters in lower case
and the first four and five letters of longer ones, hashed into BUCKETS.

Fitting has two passes on the driver, both by AdaGrad in batches. A first machine has all terms that occur in LEAST_ROWS
learnt rows or more; it finds what matters in pairs even where the parts tell nothing alone. The final machine has the
TERMS terms with the largest effect in the first one and the TERMS most telling by themselves (chi squared), so that
thousands of terms that only fit noise don't enter long texts' scores. Learnt from are at most FIT_ROWS labelled ids by a
hash of the id, and of those, in that order, as many rows as have FIT_TERMS terms in all. Scoring is row by row over whole texts.

Null and empty texts score as a text without terms. Labels that are null teach nothing; without both
classes the score is 0 for all, or the share of the one class. Null ids pass through, repeated rows are
scored each (their label counts once if they agree, as toxic if any says so). No rows give no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bucket, map_rows
from weftline.session import written

BUCKETS, TERMS, RANK, FIT_ROWS, FIT_TERMS, LEAST_ROWS = 1 << 20, 1024, 6, 20_000, 8_000_000, 3
#: Chi squared under which a term tells nothing by itself; AdaGrad steps of the first machine at least.
LEAST_CHI, FIRST_STEPS = 6.0, 500
WORD = re.compile(r"[^\W\d_]+")


def parts(text: str | None) -> set[str]:
    """Words, and the beginnings of longer ones (inflected words share them)."""
    words = set(WORD.findall((text or "").lower()))
    long = [w for w in words if len(w) > 5]
    words.update(["^" + w[:4] for w in long])
    words.update(["^" + w[:5] for w in long])
    return words


def terms(text: str | None) -> np.ndarray:
    """The distinct hashed terms of a text."""
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in parts(text)), np.int32))


class Machine:
    """A fitted factorization machine."""

    def __init__(self, known: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.at = {int(b): i for i, b in enumerate(known)}
        self.w0, self.w, self.v = w0, w, v

    def score(self, text: str | None) -> float:
        get = self.at.get
        i = list({x for t in parts(text) if (x := get(zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS)) is not None})
        z = self.w0
        if i:
            i.sort()
            v = self.v[i]
            s = v.sum(axis=0)
            z += float(self.w[i].sum() + 0.5 * (s @ s - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def first_machine(rows: list[np.ndarray], y: np.ndarray, k: int, rank: int = 4, batch: int = 256, rate: float = 0.1, l2: float = 1e-3) -> np.ndarray:
    """The effect of each of ``k`` terms in a machine over all of them: the root of its summed squared shares of the learnt rows' scores.

    ``rows`` are arrays of terms from 0 to k - 1; what is held besides them is two machines' weights and one batch.
    """
    n, r = len(rows), np.random.default_rng(4)
    size = np.array([len(x) for x in rows])
    w, v, w0 = np.zeros(k), r.normal(0, 0.05, (rank, k)), float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, g0 = np.full(k, 1e-2), np.full((rank, k), 1e-2), 1e-2
    rounds = min(60, max(6, -(-FIRST_STEPS * batch // n)))
    effect = np.zeros(k)
    for turn in range(rounds + 1):
        order = r.permutation(n)
        for at in range(0, n, batch):
            b = order[at : at + batch]
            cols, own, m = np.concatenate([rows[i] for i in b]), np.repeat(np.arange(len(b)), size[b]), len(b)
            s = [np.bincount(own, v[f][cols], m) for f in range(rank)]
            if turn == rounds:  # the last turn only looks
                share = w[cols] + sum(v[f][cols] * (s[f][own] - v[f][cols]) for f in range(rank))
                effect += np.bincount(cols, share * share, k)
                continue
            z = w0 + np.bincount(own, w[cols], m) + 0.5 * sum(s[f] * s[f] - np.bincount(own, v[f][cols] ** 2, m) for f in range(rank))
            d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[b]) / m
            g = np.bincount(cols, d[own], k)
            dw = g + l2 * w
            gw += dw * dw
            w -= rate * dw / np.sqrt(gw)
            for f in range(rank):
                dv = np.bincount(cols, (d * s[f])[own], k) - g * v[f] + l2 * v[f]
                gv[f] += dv * dv
                v[f] -= rate * dv / np.sqrt(gv[f])
            g0 += d.sum() ** 2
            w0 -= rate * d.sum() / np.sqrt(g0)
    return np.sqrt(effect)


def chosen_terms(rows: list[np.ndarray], y: np.ndarray, keep: int = TERMS) -> np.ndarray:
    """The terms of the final machine: those with the largest effect in a first one, and those that tell by themselves."""
    n, pos = len(rows), y.sum()
    df, hit = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x, label in zip(rows, y):
        df[x] += 1
        hit[x] += label
    often = np.flatnonzero(df >= min(LEAST_ROWS, n))
    if not len(often):
        return often
    want = df[often] * pos / n
    chi = (hit[often] - want) ** 2 / want + (hit[often] - want) ** 2 / (df[often] - want)
    telling = np.argsort(-chi, kind="stable")[:keep]
    telling = telling[chi[telling] > LEAST_CHI]
    place = np.full(BUCKETS, -1, np.int32)
    place[often] = np.arange(len(often))
    effect = first_machine([p[p >= 0] for p in (place[x] for x in rows)], y, len(often))
    return often[np.union1d(telling, np.argsort(-effect, kind="stable")[:keep])]


def fit_machine(rows: list[np.ndarray], y: np.ndarray, rank: int = RANK, keep: int = TERMS, rounds: int = 30, batch: int = 256, rate: float = 0.1, l2: float = 2e-4) -> Machine:
    """Fit on rows of hashed terms and labels 0/1."""
    n, pos = len(rows), int(y.sum()) if len(rows) else 0
    if pos == 0 or pos == n:
        return Machine(np.zeros(0, int), 35.0 if n and pos else -35.0, np.zeros(0), np.zeros((0, rank)))
    known = chosen_terms(rows, y, keep)
    k = len(known)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(k)
    x = np.zeros((n, k), np.uint8)
    for i, row in enumerate(rows):
        p = place[row]
        x[i, p[p >= 0]] = 1
    r = np.random.default_rng(4)
    w, v = np.zeros(k), r.normal(0, 0.05, (k, rank))
    w0 = float(np.log(pos / (n - pos)))
    gw, gv, g0 = np.full(k, 1e-2), np.full((k, rank), 1e-2), 1e-2
    for _ in range(rounds):
        order = r.permutation(n)
        for at in range(0, n, batch):
            b = order[at : at + batch]
            xb = x[b].astype(float)
            s = xb @ v
            z = w0 + xb @ w + 0.5 * ((s * s).sum(axis=1) - xb @ (v * v).sum(axis=1))
            d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[b]) / len(b)
            own = xb.T @ d
            dw = own + l2 * w
            dv = xb.T @ (d[:, None] * s) - own[:, None] * v + l2 * v
            gw, gv, g0 = gw + dw**2, gv + dv**2, g0 + d.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            w0 -= rate * d.sum() / np.sqrt(g0)
    return Machine(known, float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", fit_rows: int = FIT_ROWS, fit_terms: int = FIT_TERMS) -> Machine:
    """A machine from at most ``fit_rows`` labelled ids and ``fit_terms`` terms; hashed terms (not texts) come to the driver."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max(F.when(F.col("y") != 0, 1).otherwise(0)).alias("y"))
    order = F.xxhash64(F.col("k").cast("string"), F.lit("fit")).alias("h")
    chosen = known.select("k", "y", order).orderBy("h", "k").limit(fit_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # fit_rows ids at most

    def run(lists):
        for part in lists:
            yield [(r[0], int(r[2]), r[3], len(t := terms(r[1])), t.tobytes()) for r in part]

    hashed = written(map_rows(rows.select("k", "t", "y", "h"), run, "k long, y int, h long, n int, terms binary"), "fit-terms")
    # how many hashes from the least on have fit_terms terms at most: fit_rows numbers
    sizes = hashed.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").toPandas()
    last = sizes["h"][sizes["n"].cumsum() <= fit_terms]
    if last.empty and len(sizes):
        last = sizes["h"][:1]
    got = sorted((r.k, bytes(r.terms), r.y) for r in hashed.where(F.col("h") <= F.lit(int(last.iloc[-1]) if len(last) else 0)).select("k", "terms", "y").toLocalIterator())
    return fit_machine([np.frombuffer(t, np.int32) for _, t, _ in got], np.array([y for *_, y in got], float))


def score(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    def run(lists):
        for rows in lists:
            yield [(r[0], machine.score(r[1])) for r in rows]

    return map_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, score double")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; ``held_out``: crc32 of the id's text mod 5 is 0 (false for null ids)."""
    machine = fit(docs, labels.where(bucket(F.col("doc_id"), 5) != 0))
    out = score(docs, machine)
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
