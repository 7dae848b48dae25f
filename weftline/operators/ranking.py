"""Graph ranking by a lazy walk: rank' = keep * rank + (1 - keep) * sum over in-edges of rank / out-degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.iterate import loop
from weftline.session import checkpoint

KEEP = 0.85


def mesh_edges(spark, nx: int, ny: int) -> DataFrame:
    """Four-neighbour edges, both ways, of a mesh of nx x ny vertices; id = x * ny + y."""
    v = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("x"), (F.col("id") % ny).alias("y"), "id")
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
    n = v.withColumn("s", step).select(F.col("id").alias("src"), (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"))
    return n.where((F.col("x") >= 0) & (F.col("x") < nx) & (F.col("y") >= 0) & (F.col("y") < ny)).select("src", (F.col("x") * ny + F.col("y")).alias("dst"))


def edge_owner(src, dst, vertices: int, parts: int):
    """The part that owns an edge: the block of its smaller end."""
    return F.least(F.floor(F.least(src, dst) / max(1, vertices // parts)), F.lit(parts - 1))


def walk(edges: DataFrame, trips: int, keep: float = KEEP, both_ways: bool = False) -> DataFrame:
    """``v, rank`` after ``trips`` trips from rank 1, for every vertex of an edge; one without out-edges keeps its share and sends nothing.

    A vertex's own share is an edge to itself, so a trip is one join and one sum. Edges are shuffled once, by source; degrees,
    own shares and first ranks are made where they lie, and the weights kept there (in memory, spilling to disk) while the trips
    run, so a trip shuffles ranks and shares, not edges; they are let go when the ranks are written. ``both_ways``: every
    edge is known to be there in both directions, so that all vertices are sources.
    """
    edges = edges.select("src", "dst")
    rows = edges
    if not both_ways:
        edges = edges.persist()
        rows = edges.unionByName(edges.select(F.col("dst").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")).distinct())
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = Window.partitionBy("src")
    share = F.when(F.col("dst").isNotNull(), F.struct("dst", ((1 - keep) / F.count("dst").over(by)).alias("w")))
    own = F.when(F.row_number().over(by.orderBy("src")) == 1, F.struct(F.col("src").alias("dst"), F.lit(keep).alias("w")))
    each = rows.repartition(parts, "src").select("src", share.alias("share"), own.alias("own"))
    weights = each.select("src", F.explode(F.array_compact(F.array("share", "own"))).alias("e")).select("src", "e.*").persist()

    def body(state, _):
        moved = weights.join(state["rank"].withColumnRenamed("v", "src"), "src")
        return {"rank": moved.groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("w") * F.col("rank")).alias("rank"))}

    try:
        return checkpoint(loop({"rank": weights.where("src = dst").select(F.col("src").alias("v"), F.lit(1.0).alias("rank")).distinct()}, trips, body)["rank"])
    finally:
        weights.unpersist()
        edges.unpersist()
