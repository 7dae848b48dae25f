"""K-means on long vectors (id, dim, x): assign to the closest centre, then move centres; empty ones stay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.iterate import loop
from weftline.session import checkpoint


def assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``id, v, c, d2``: the closest centre (ties: the lowest). points: id, v (array); centres: c, m (array), K rows, which go to every task.

    Distances are sums of squared differences over batches of points; K rows of centres come to the driver, as few as the problem says.
    """
    rows = sorted((r.c, list(r.m)) for r in centres.select("c", "m").collect())
    names, m = np.array([c for c, _ in rows], np.int64), np.array([v for _, v in rows], np.float64).reshape(len(rows), -1)
    at_once = max(1, 2_000_000 // max(1, m.size))

    def run(frames):
        for f in frames:
            v = np.array(f["v"].tolist(), np.float64).reshape(len(f), -1)
            best, d2 = np.zeros(len(f), np.int64), np.zeros(len(f))
            for lo in range(0, len(f), at_once):
                d = np.round(((v[lo : lo + at_once, None, :] - m) ** 2).sum(axis=2), 9)
                k = d.argmin(axis=1)
                best[lo : lo + at_once], d2[lo : lo + at_once] = names[k], d[np.arange(len(k)), k]
            yield f.assign(c=best, d2=d2)

    own = points.select("id", F.col("v").cast("array<double>").alias("v"))
    return own.mapInPandas(run, T.StructType([*own.schema.fields, T.StructField("c", T.LongType()), T.StructField("d2", T.DoubleType())]))


def move(assigned: DataFrame, centres: DataFrame, dims: int | None = None) -> DataFrame:
    """The means of the assigned points; a centre without points keeps its place. With ``dims``, a point is one row of ``dims`` sums, not ``dims`` rows."""
    if dims is None:
        sums = assigned.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
        means = sums.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("x")))), lambda p: p["x"]).alias("new"))
    else:
        sums = assigned.groupBy("c").agg(*(F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(dims)))
        means = sums.select("c", F.filter(F.array(*(f"m{i}" for i in range(dims))), lambda x: x.isNotNull()).alias("new"))
    return centres.join(means, "c", "left").select("c", F.coalesce("new", "m").alias("m"))


def kmeans(points: DataFrame, centres: DataFrame, trips: int) -> DataFrame:
    """Centres after ``trips`` trips. The points are kept in memory while the trips run; K rows of centres are written each trip."""
    centres = checkpoint(centres)
    dims = centres.agg(F.coalesce(F.max(F.size("m")), F.lit(0))).first()[0]
    kept = points.select("id", "v").persist()
    try:
        return checkpoint(loop({"c": centres}, trips, lambda s, _: {"c": move(assign(kept, s["c"]), s["c"], dims)}, cut_every=1)["c"])
    finally:
        kept.unpersist()
