"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its K nearest reference points (pivots), in order. Inverted lists go from a
pivot to the vectors that name it; vectors that share at least SHARED pivots, or have the same nearest
one, are candidates, and the cosine in double precision decides. A pair is taken in one list only, that of the least pivot it shares,
so links can be counted without collecting or deduplicating pairs: a list (or a pair of its blocks of
about BLOCK vectors, if it's long) returns per vector the number of links and a spanning forest.

The number of pivots grows with the vectors: in proportion until lists would be LIST long, from then on as PIVOTS_ROOT
times the square root, with no bound beside that, so that neither the lists nor the pivots (which the driver holds)
grow as fast as the vectors; with more pivots, a vector names more of them (places()), since the chance to share
two of eight falls. Pivots are drawn from a sample of the vectors (at most SAMPLE, or four for each pivot, by a hash of
the id), dimension by dimension, so that no two of them have a cosine of APART or more, and the rest are random
directions. A group of near copies thus has one pivot or a few, whatever its size: its members' nearest pivots aren't
ranked by the copies' noise alone, and those nearest to the same pivot are all compared. Every vector is indexed. Exact
copies (by 128 bits of hashes) are indexed once and counted. The links inside one group are counted
pair by pair, so a group's cost is the square of its different vectors, spread over pairs of blocks.

Of pairs at cosine 0.9 in 64 dimensions, with random pivots, 99.0 % are candidates with 1,024 pivots and 8 named, 99.0 %
with 4,096 and 10, 99.2 % with 16,384 and 12, 98.6 % with 65,536 and 14; more when closer (tests measure).

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, link
with nothing; vectors of different lengths don't link. Repeated rows are vectors of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import join_hot, map_rows
from weftline.llm.graph import components
from weftline.session import checkpoint

LEAST, K, SHARED, APART = 0.9, 8, 2, 0.7
LIST, BLOCK, SAMPLE, PIVOTS_ROOT = 1000, 2048, 20_000, 4.0


def pivot_count(n: int) -> int:
    """Pivots for ``n`` different vectors."""
    return max(16, int(min(n * K / LIST, PIVOTS_ROOT * n**0.5)))


def places(pivots: int) -> int:
    """How many of its nearest pivots a vector names: K up to 1,024 pivots, two more for each further factor of four."""
    k, most = K, 1024
    while pivots > most:
        k, most = k + 2, most * 4
    return k


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def thinned(v: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of the unit vectors whose cosine with each one kept before is under APART."""
    kept = v[:0]
    for at in range(0, len(v), 256):
        part = v[at : at + 256]
        part = part[(part @ kept.T < APART).all(axis=1)]
        far, own = part @ part.T < APART, []
        for i in range(len(part)):
            if far[i, own].all():
                own.append(i)
        kept = np.concatenate([kept, part[own]])
        if len(kept) >= most:
            break
    return kept[:most]


class Pivots:
    """Reference points by dimension."""

    def __init__(self, sample: dict[int, np.ndarray], n: int):
        self.drawn, self.n, self.made = sample, n, {}

    def of(self, dim: int) -> np.ndarray:
        if dim not in self.made:
            own, r = self.drawn.get(dim, np.zeros((0, dim))), np.random.default_rng(dim)
            extra = r.normal(size=(max(0, self.n - len(own)), dim))
            self.made[dim] = np.concatenate([own[: self.n], unit(extra)]) if len(extra) else own[: self.n]
        return self.made[dim]

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """Per unit vector, its places() nearest pivots in order (ties: the lower)."""
        c = np.round(v @ self.of(v.shape[1]).T, 12)
        k = min(places(self.n), c.shape[1])
        near = np.argpartition(-c, k - 1, axis=1)[:, :k]
        return np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(c, near, axis=1))), axis=1).astype(np.int32)


def permutations(reps: DataFrame, pivots: Pivots) -> DataFrame:
    """``id, mult, dim, near, v``: the permutation prefix (the K nearest in order) and the unit vector's bytes."""

    def run(lists):
        for rows in lists:
            by_dim: dict[int, list] = {}
            for r in rows:
                by_dim.setdefault(len(r[1]), []).append(r)
            for dim, own in by_dim.items():
                v = unit(np.array([r[1] for r in own], np.float64))
                yield [(r[0], r[2], dim, near.tolist(), x.tobytes()) for r, near, x in zip(own, pivots.nearest(v), v)]

    return map_rows(reps.select("id", "v", "mult"), run, "id long, mult long, dim int, near array<int>, v binary")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row reachable of each of n rows, by links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the vectors of two blocks of one pivot's list, or within one block."""
    pivot, one, two = (int(rows[c].iloc[0]) for c in ("pivot", "lo", "hi"))
    rows = rows.sort_values(["id"], kind="stable")
    near = np.array(rows["near"].tolist())
    v = np.frombuffer(b"".join(rows["v"]), np.float64).reshape(len(rows), -1)
    side, mult, ids = rows["block"].to_numpy(), rows["mult"].to_numpy(), rows["id"].to_numpy()
    local, cols = np.unique(near, return_inverse=True)
    hot = np.zeros((len(rows), len(local)), np.float32)
    np.put_along_axis(hot, cols.reshape(near.shape), 1, axis=1)
    low, home = hot[:, local < pivot], near[:, 0] == pivot
    left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
    n, links = np.zeros(len(rows), np.int64), []
    for a0 in range(0, len(left), 512):
        a = left[a0 : a0 + 512]
        for b0 in range(0, len(right), 512):
            b = right[b0 : b0 + 512]
            found = (hot[a] @ hot[b].T >= SHARED) | home[a][:, None] & home[b]
            found &= (low[a] @ low[b].T == 0) & (v[a] @ v[b].T >= LEAST)
            if one == two:
                found &= a[:, None] < b[None, :]
            i, j = np.nonzero(found)
            if len(i):
                x, y = a[i], b[j]
                n += np.bincount(x, mult[y], len(rows)).astype(np.int64) + np.bincount(y, mult[x], len(rows)).astype(np.int64)
                links.append(np.stack([x, y]))
        if len(links) > 4:
            links = [_kept(links, len(rows))]
    if links:
        root = _forest(*np.concatenate(links, axis=1), len(rows))
        on = n > 0
        return pd.DataFrame({"id": ids[on], "n": n[on], "root": ids[root[on]]})
    return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")


def _kept(links: list[np.ndarray], n: int) -> np.ndarray:
    root = _forest(*np.concatenate(links, axis=1), n)
    own = np.flatnonzero(root != np.arange(n))
    return np.stack([own, root[own]])


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vectors``."""
    every = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("vec_id").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    usable = every.where(ok).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))
    reps = checkpoint(usable.groupBy("h1", "h2", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("mult")))
    n = reps.count()
    want = pivot_count(n)
    drawn: dict[int, list] = {}
    for r in reps.select("id", "v").orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(max(min(SAMPLE, 4 * want), want)).toLocalIterator():
        drawn.setdefault(len(r.v), []).append(np.array(r.v, np.float64))
    pivots = Pivots({d: thinned(unit(np.array(v)), want) for d, v in drawn.items()}, want)
    index = checkpoint(permutations(reps, pivots))
    # sharing SHARED pivots, two vectors share one of the K - SHARED + 1 least of each; the nearest is posted always
    least = F.slice(F.array_sort("near"), 1, F.greatest(F.size("near") - SHARED + 1, F.lit(1)))
    posted = index.withColumn("pivot", F.explode(F.array_union(least, F.slice("near", 1, 1))))
    # a number of blocks per list: as many rows as there are pivots, a dimension
    blocks = posted.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parts = posted.join(blocks, ["dim", "pivot"]).withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("dim", "pivot", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "mult", "near", "v")
    found = checkpoint(parts.groupBy("dim", "pivot", "lo", "hi").applyInPandas(_block, "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select("id", "root"), "id", "root")
    by_vector = reps.select("h1", "h2", "id", "mult").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    by_vector = by_vector.select("h1", "h2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    # vectors stay where they are: ids and hashes meet; a vector with very many copies doesn't go to one task
    known = join_hot(usable.select("vec_id", "h1", "h2"), checkpoint(by_vector), ["h1", "h2"], "mult").select("vec_id", "n_links", "component_id")
    rest = every.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(rest)


def op9(vectors: DataFrame) -> DataFrame:
    return linked(vectors).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
