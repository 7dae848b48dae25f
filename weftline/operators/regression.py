"""Logistic regression by full gradients: g = sum of (sigmoid(w x) - y) x, w -= rate * g."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.vec import sigmoid
from weftline.operators.iterate import while_loop


def gradient(samples: DataFrame, w: list[float], plus_minus: bool = False) -> list[float]:
    """The summed gradient over (x array, y), one row to the driver; y is a boolean, or -1/+1 with ``plus_minus``."""
    dot = sum((F.col("x")[i] * F.lit(float(v)) for i, v in enumerate(w)), F.lit(0.0))
    factor = F.col("y") * (sigmoid(F.col("y") * dot) - 1) if plus_minus else sigmoid(dot) - F.col("y").cast("double")
    row = samples.select("x", factor.alias("f")).agg(*(F.sum(F.col("f") * F.col("x")[i]).alias(f"g{i}") for i in range(len(w)))).first()
    return [v or 0.0 for v in row]


def fit(samples: DataFrame, w: list[float], trips: int, rate: float, plus_minus: bool = False) -> list[float]:
    """``trips`` steps. The samples are read once a trip and summed map-side; weights live on the driver."""
    for _ in range(max(0, trips)):
        w = [a - rate * g for a, g in zip(w, gradient(samples, w, plus_minus))]
    return w


def fit_while(samples: DataFrame, w: list[float], rate: float, tolerance: float, most: int = 200) -> tuple[list[float], int]:
    """Steps while |step|^2 / |w|^2 >= tolerance (the first always runs); raises after ``most``.

    The state of the loop is one row: the weights, which the driver puts into the gradient's expression, and the last ratio.
    Samples are read once a trip and summed map-side.
    """
    spark, schema = samples.sparkSession, "w array<double>, ratio double"

    def body(state, _):
        now = state["w"].first().w
        step = [rate * g for g in gradient(samples, now)]
        moved = [a - b for a, b in zip(now, step)]
        return {"w": spark.createDataFrame([(moved, sum(v * v for v in step) / max(sum(v * v for v in moved), 1e-300))], schema)}

    state, trips = while_loop({"w": spark.createDataFrame([([float(v) for v in w], float("inf"))], schema)}, lambda r: r.ratio >= tolerance, "w", body, most)
    return list(state["w"].first().w), trips
