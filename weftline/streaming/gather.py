"""Gather over a stream of messages: a partition's inbox fires when its expected number has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "stage long, part long, messages long, total double"


def _fire(expected: int):
    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b["value"].sum())
        if n > expected:
            raise ValueError(f"stage {key[0]}, partition {key[1]}: more than {expected} messages")
        if n == expected:
            state.remove()
            yield pd.DataFrame([(*key, n, total)], columns=["stage", "part", "messages", "total"])
        else:
            state.update((n, total))

    return run


def gather_stream(messages: DataFrame, expected: int) -> DataFrame:
    """``stage, dst, value`` rows of a stream to one row per inbox that is full; state is a count and a sum per open inbox."""
    return messages.groupBy("stage", "dst").applyInPandasWithState(_fire(expected), OUT, "n long, total double", "append", "NoTimeout")


def windowed_totals(messages: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Counts and sums by tumbling window and partition, with late rows dropped after ``late``."""
    w = F.window(time, width)
    return messages.withWatermark(time, late).groupBy(w, "dst").agg(F.count("*").alias("messages"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "dst", "messages", "total")
