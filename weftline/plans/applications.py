"""Applications written as programs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.program import Program, application


@application("sumup")
def sumup(params: dict) -> Program:
    """Ones in ``partitions`` partitions, summed by layers ``iterations`` times."""
    p = Program("sumup", params)
    parts, trips, mid, n = p.param("partitions", 2), p.param("iterations", 10), p.param("intermediate", 4), p.param("doubles", 100)
    data, layer, total = p.declare("data", "v double", parts), p.declare("layer", "s double", mid), p.declare("total", "s double", 1)

    def fill(f):
        spark = f["data"].sparkSession
        return {"data": spark.range(parts * (n // parts)).select((F.col("id") % parts).alias("part"), F.lit(1.0).alias("v"))}

    fold = lambda name: lambda f, box: {name: box.select("part", F.aggregate("messages", F.lit(0.0), lambda a, m: a + m["s"]).alias("s"))}
    p.writing(data).transform(fill)
    p.loop(trips)
    p.reading(data).scatter(lambda f: f["data"].groupBy("part").agg(F.sum("v").alias("s")).select((F.col("part") % mid).alias("dst"), "s"))
    p.writing(layer).gather(fold("layer"))
    p.reading(layer).scatter(lambda f: f["layer"].select(F.lit(0).cast("long").alias("dst"), "s"))
    p.tracked().writing(total).gather(fold("total"), expect=mid)
    p.end_loop()
    return p


@application("barrier")
def barrier(params: dict) -> Program:
    """A value sent to all partitions and summed back: P^iterations."""
    p = Program("barrier", params)
    parts, trips = p.param("partitions", 2), p.param("iterations", 10)
    one, all_ = p.declare("one", "v long", 1), p.declare("all", "v long", parts)
    p.writing(one).transform(lambda f: {"one": f["one"].sparkSession.range(1).select(F.col("id").alias("part"), F.lit(1).cast("long").alias("v"))})
    p.loop(trips)
    p.reading(one).scatter(lambda f: f["one"].select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")).alias("dst"), "v"))
    p.writing(all_).gather(lambda f, box: {"all": box.select("part", F.col("messages")[0]["v"].alias("v"))}, expect=1)
    p.reading(all_).scatter(lambda f: f["all"].select(F.lit(0).cast("long").alias("dst"), "part", "v"))
    p.writing(one).gather(lambda f, box: {"one": box.select("part", F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + m["v"]).alias("v"))}, expect=parts)
    p.end_loop()
    return p


@application("halving")
def halving(params: dict) -> Program:
    """A value halved while it is at least ``tolerance``."""
    p = Program("halving", params)
    tolerance, x = p.param("tolerance", 0.1), p.declare("x", "v double", 1)
    p.writing(x).transform(lambda f: {"x": f["x"].sparkSession.range(1).select(F.col("id").alias("part"), F.lit(1.0).alias("v"))})
    p.reading(x).while_(lambda f: f["x"].first().v >= tolerance)
    p.writing(x).transform(lambda f: {"x": f["x"].withColumn("v", F.col("v") / 2)})
    p.end_while()
    return p
