"""Running values in blocks against one window over all rows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import control


def test_running_values_go_by_blocks(spark, monkeypatch):
    """Failed before: all rows were one task's window. Ties, missing values and a missing start are as in that window."""
    monkeypatch.setattr(control, "BLOCK_ROWS", 50)
    r = np.random.default_rng(0)
    rows = [(int(r.integers(0, 400)), None if i % 5 == 0 else int(r.integers(0, 50)), None if i % 7 == 0 else int(r.integers(0, 50))) for i in range(600)]
    rows += [(-1, None, None), (-2, None, 3), (500, None, None)]
    df = spark.createDataFrame(rows, "seq long, a long, b long")
    blocks = control.in_order(df, "seq")
    assert blocks.select("__block").distinct().count() > 5 and blocks.groupBy("seq").agg(F.countDistinct("__block").alias("n")).where("n > 1").isEmpty()
    w = Window.orderBy("seq")
    want = df.select("seq", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    key = lambda t: tuple((x is not None, x or 0) for x in t)
    sums = control.running_sums(blocks, "seq", "a", "b")
    assert sorted((tuple(x) for x in sums.select("seq", "a", "b").collect()), key=key) == sorted((tuple(x) for x in want.collect()), key=key)

    near = want.select("seq", F.col("a").cast("double").alias("a"), F.when(F.abs("seq") < 100, F.col("b") * 3).otherwise(F.col("b")).cast("double").alias("b"))
    ratio = F.col("a") / F.nullif("b", F.lit(0))
    now = F.when(ratio < 0.9, "a").when(ratio > 1.1, "b")
    want = near.select("seq", F.last(now, ignorenulls=True).over(w).alias("first"))
    got = control.fair_share(near, 1.0, 0.1).select("seq", "first")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert control.fair_share(near.limit(0), 1.0, 0.1).count() == 0
