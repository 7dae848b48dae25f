"""Smoothed-particle hydrodynamics on a table of particles: id, x, y, z, vx, vy, vz (and half-step hx, hy, hz)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.spatial import AXES, Leaves, leaf_pairs, scratch, squares, tiles
from weftline.session import checkpoint

GRAVITY, DT, STIFFNESS, VISCOSITY, REST_DENSITY = -9.8, 0.001, 3.0, 0.4, 1000.0


class Fluid:
    """Constants from the number of particles per metre at rest."""

    def __init__(self, per_metre: float):
        self.h = 1.695 / per_metre
        self.mass = REST_DENSITY / per_metre**3
        h = self.h
        self.density = 315.0 / (64.0 * math.pi * h**9) * self.mass
        self.pressure = 3.0 * 15.0 / (math.pi * h**6) * 0.5 * STIFFNESS * self.mass
        self.viscosity = VISCOSITY * 45.0 / (math.pi * h**6) * self.mass


def density(p: DataFrame, f: Fluid) -> DataFrame:
    """``p`` with ``rho`` = (sum over others within h of (h^2 - d^2)^3, plus h^6) times the coefficient.

    Two leaves of a tile are one block of distances, used both ways; a particle has one sum a tile.
    """
    h, h2 = f.h, f.h * f.h

    def kernel(a, b):
        def block(i, j, same, p, q):
            w = squares(p.at[i], q.at[j])
            np.subtract(h2, w, out=w)
            np.maximum(w, 0.0, out=w)
            if same is not None:
                w[same] = 0.0
            w *= np.multiply(w, w, out=scratch(1, *w.shape))
            return w.sum(axis=1), w.sum(axis=0)

        yield from _sums(a, b, h, 1, block)

    sums = tiles(p.select("id", *AXES), None, kernel, "id long, __s double").groupBy("id").agg(F.sum("__s").alias("__s"))
    return p.join(sums, "id", "left").withColumn("rho", (F.coalesce("__s", F.lit(0.0)) + f.h**6) * f.density).drop("__s")


def forces(p: DataFrame, f: Fluid) -> DataFrame:
    """``p`` (with rho) with accelerations ax, ay, az from pressure, viscosity and gravity; pairs act in opposite ways.

    Blocks as in density(). On an axis on which either velocity is missing a pair has no force. p is written once, as it is used twice.
    """
    p = checkpoint(p)
    h, pressure, viscosity = f.h, f.pressure, f.viscosity

    def kernel(a, b):
        fields = [[t["rho"].to_numpy(), *(t[f"v{x}"].to_numpy() for x in AXES), *(t[f"v{x}"].is_null().to_numpy() for x in AXES)] for t in (a, b)]
        plain = all(np.isfinite(c).all() for own in fields for c in own[:4])

        def pair_by_pair(l, r, x, y, d, drag):
            """Force of each pair by axis, as the sums in SQL have it, for missing or infinite velocities."""
            both, near = np.multiply.outer(l[0], r[0]), drag > 0
            push = pressure * drag * drag / d * (np.add.outer(l[0], r[0]) - 2 * REST_DENSITY) / both
            drag = viscosity * drag / both
            out = [np.subtract.outer(x[k], y[k]) * push + np.subtract.outer(-l[1 + k], -r[1 + k]) * drag for k in range(3)]
            w = np.stack([np.where(near & ~np.logical_or.outer(l[4 + k], r[4 + k]), o, 0.0) for k, o in enumerate(out)])
            return w.sum(axis=2), -w.sum(axis=1)

        def one_way(push, drag, l, r, x, y):
            """Forces on particles at x from those at y: a sum over pairs of (x - y) times a weight is x times the weights less the weighted y."""
            u, v = 1 / l[0], 1 / r[0]
            n = push @ np.stack([np.ones_like(v), *y, v, *(y * v)]).T
            m = drag @ np.stack([v, *(np.stack(r[1:4]) * v)]).T
            near, heavy = x * n[:, 0] - n[:, 1:4].T, x * n[:, 4] - n[:, 5:].T
            return pressure * (u * near + (1 - 2 * REST_DENSITY * u) * heavy) + viscosity * u * (m[:, 1:].T - np.stack(l[1:4]) * m[:, 0])

        def block(i, j, same, p, q):
            l, r = ([c[t.rows[k]] for c in own] for own, t, k in zip(fields, (p, q), (i, j)))
            d = squares(p.at[i], q.at[j])
            np.maximum(d, 1e-12, out=d)
            np.sqrt(d, out=d)
            drag = np.subtract(h, d, out=scratch(1, *d.shape))
            np.maximum(drag, 0.0, out=drag)
            if same is not None:
                drag[same] = 0.0
            middle = p.at[i].mean(axis=1, keepdims=True)
            x, y = p.at[i] - middle, q.at[j] - middle
            if not plain:
                return pair_by_pair(l, r, x, y, d, drag)
            push = np.multiply(drag, drag, out=scratch(2, *d.shape))
            push /= d
            return one_way(push, drag, l, r, x, y), one_way(push.T, drag.T, r, l, y, x)

        yield from _sums(a, b, h, 3, block)

    names = [f"__{a}" for a in AXES]
    parts = tiles(p.select("id", *AXES, *(f"v{a}" for a in AXES), "rho"), None, kernel, "id long, " + ", ".join(f"{n} double" for n in names))
    out = p.join(parts.groupBy("id").agg(*(F.sum(n).alias(n) for n in names)), "id", "left")
    return out.select(*p.columns, *((F.coalesce(n, F.lit(0.0)) + (GRAVITY if a == "y" else 0.0)).alias(f"a{a}") for a, n in zip(AXES, names)))


def _sums(a, b, h: float, width: int, block):
    """Sums by particle, of two groups, of what ``block(i, j, same, p, q)`` gives for two leaves: ``width`` sums for each
    particle of the first, and of the second. ``same``: where both are one id, None if nowhere.
    """
    p = Leaves(a)
    q = p if b is a else Leaves(b)
    ids = [t["id"].to_numpy() for t in (a, b)]
    both = ids[0] if b is a else np.concatenate(ids)
    repeated = len(np.unique(both)) < len(both)
    sums = [np.zeros((width, len(x))) for x in ids[: 1 if b is a else 2]]
    for i, j in leaf_pairs(p, q, h):
        own = b is a and i == j
        to, back = block(i, j, np.equal.outer(ids[0][p.rows[i]], ids[1][q.rows[j]]) if own or repeated else None, p, q)
        sums[0][:, p.rows[i]] += to
        if not own:
            sums[-1][:, q.rows[j]] += back
    for k, s in enumerate(sums):
        yield [ids[k], *s]


def wall_forces(p: DataFrame, low: float, high: float, reach: float, spring: float = 30000.0, damping: float = 128.0) -> DataFrame:
    """Springs and dampers at the six walls of a cube push particles back that are within ``reach``."""
    cols = {}
    for a in AXES:
        under, over = reach - (F.col(a) - low), reach - (high - F.col(a))
        back = F.when(under > 1e-10, spring * under - damping * F.col(f"v{a}")).otherwise(0.0) - F.when(over > 1e-10, spring * over + damping * F.col(f"v{a}")).otherwise(0.0)
        cols[f"a{a}"] = F.col(f"a{a}") + back
    return p.withColumns(cols)


def advance(p: DataFrame, dt: float = DT) -> DataFrame:
    """Leapfrog: the half-step velocity moves on by a dt, positions by it, and the velocity is the mean of both halves."""
    half = {a: F.col(f"h{a}") + F.col(f"a{a}") * dt for a in AXES}
    new = {f"{a}": F.col(a) + half[a] * dt for a in AXES} | {f"v{a}": (F.col(f"h{a}") + half[a]) / 2 for a in AXES} | {f"h{a}": half[a] for a in AXES}
    return p.select(*(new[c].alias(c) if c in new else F.col(c) for c in p.columns))


def reflect(p: DataFrame, low: float, high: float) -> DataFrame:
    """Particles past a wall are mirrored into the cube, and their velocities on that axis turned."""
    out = {}
    for a in AXES:
        past = (F.col(a) < low) | (F.col(a) > high)
        out[a] = F.when(F.col(a) < low, 2 * low - F.col(a)).when(F.col(a) > high, 2 * high - F.col(a)).otherwise(F.col(a))
        for v in (f"v{a}", f"h{a}"):
            out[v] = F.when(past, -F.col(v)).otherwise(F.col(v))
    return p.select(*(out[c].alias(c) if c in out else F.col(c) for c in p.columns))


def energy(p: DataFrame) -> DataFrame:
    return p.agg(F.sum(F.col("rho") * F.sqrt(sum((F.col(f"v{a}") * F.col(f"v{a}") for a in AXES), F.lit(0.0)))).alias("energy"))


def replicate(p: DataFrame, folds: tuple[int, int, int], width: float) -> DataFrame:
    """Copies of all particles side by side, with ids of their own: id * copies + copy."""
    nx, ny, nz = folds
    n = nx * ny * nz
    c = p.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = {"x": F.col("x") + (F.col("__c") % nx) * width, "y": F.col("y") + (F.floor(F.col("__c") / nx) % ny) * width, "z": F.col("z") + F.floor(F.col("__c") / (nx * ny)) * width, "id": F.col("id") * n + F.col("__c")}
    return c.select(*(moved[k].alias(k) if k in moved else F.col(k) for k in p.columns))


def frame(p: DataFrame, f: Fluid, low: float, high: float) -> DataFrame:
    """One time step: densities, forces, walls, leapfrog, reflection."""
    keep = p.columns
    return reflect(advance(wall_forces(forces(density(p, f), f), low, high, f.h)), low, high).select(*[c for c in keep if c != "rho"])
