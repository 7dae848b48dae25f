"""Connected components of an edge list, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import join_hot
from weftline.session import checkpoint


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, hot: int | None = None) -> DataFrame:
    """Per node that has an edge, the smallest node reachable: columns ``node``, ``root``.

    Alternating large-star and small-star rounds; each round is one or two shuffles of at most the
    edges it was given, and ends in a checkpoint. The sizes of groups play no part in memory: a star's
    centre is a min() combined before the shuffle and joined back, and the edges of a node with more than ``hot`` of
    them (common.HOT) stay where they are in that join. Nulls and loops are dropped; no edges give no rows. Raises if ``most_rounds`` didn't settle it (the rounds needed grow with the log of
    the longest path).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpoint(e)
    before, rows = None, e.count()
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        # large star: every larger neighbour of u goes to the smallest node around u
        large = join_hot(both, low, ["u"], "n", 2 * rows, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, ["u"], "n", rows, hot).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = checkpoint(small)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        rows = now[0]
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
