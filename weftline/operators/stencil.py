"""Box averages on a sparse grid of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import grid
from weftline.operators.iterate import loop


def box_average(cells: DataFrame, axes: list[str], value: str = "v", radius: int = 1) -> DataFrame:
    """Each cell's mean over the cells that exist in the box around it.

    Every cell sends (sum, count) to the cells around, one axis at a time, so the fan-out is 2 radius + 1
    per axis, not the box's volume. What a cell sent to itself along all axes tells that it exists; the others go at the end.
    """
    sums = cells.select(*axes, F.col(value).alias("__s"), F.lit(1).cast("long").alias("__n"), F.lit(True).alias("__own"))
    for a in axes:
        step = F.explode(F.array(*(F.lit(o) for o in range(-radius, radius + 1)))).alias("__o")
        sent = sums.select(*axes, "__s", "__n", "__own", step).withColumns({a: F.col(a) + F.col("__o"), "__own": F.col("__own") & (F.col("__o") == 0)}).drop("__o")
        sums = sent.groupBy(*axes).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"), F.max("__own").alias("__own"))
    return sums.where("__own").select(*axes, (F.col("__s") / F.col("__n")).alias(value))


def cube(spark, nx: int, ny: int, nz: int) -> DataFrame:
    """Cells ix, iy, iz with v = ix + iy + iz."""
    ix, iy, iz = grid.index(F.col("id"), nx, ny)
    g = spark.range(nx * ny * nz).select(ix.cast("long").alias("ix"), iy.cast("long").alias("iy"), iz.cast("long").alias("iz"))
    return g.withColumn("v", (F.col("ix") + F.col("iy") + F.col("iz")).cast("double"))


def smooth(cells: DataFrame, axes: list[str], trips: int, radius: int = 1) -> DataFrame:
    return loop({"g": cells}, trips, lambda s, _: {"g": box_average(s["g"], axes, radius=radius)}, cut_every=3)["g"]
