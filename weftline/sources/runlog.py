"""Run logs: lines that begin with B (session), L (application), P (partition), T (timestamp) or C (cycles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """``line_no`` and ``line`` to typed rows; T and C lines belong to the last P line's application.

    Line numbers order a single log, so the carry-forward is a window over one session's lines.
    """
    f = F.split(F.trim("line"), r"\s+")
    at = lambda i, t: F.try_element_at(f, F.lit(i)).try_cast(t)
    t = lines.select("line_no", f[0].alias("kind"), at(2, "int").alias("a"), at(3, "int").alias("b"), at(3, "string").alias("s"), at(4, "int").alias("c"), at(6, "int").alias("e"), at(4, "double").alias("v")).where(F.col("kind").isin("B", "L", "P", "T", "C"))
    session = F.sum(F.when(F.col("kind") == "B", 1).otherwise(0)).over(Window.orderBy("line_no"))
    t = t.withColumn("session", session)
    app = F.last(F.when(F.col("kind") == "P", F.col("a")), ignorenulls=True).over(Window.partitionBy("session").orderBy("line_no"))
    stat = F.col("kind").isin("T", "C")
    return t.select(
        "line_no", "session", "kind", F.when(F.col("kind") == "L", F.col("a")).otherwise(app).alias("app"), F.when(F.col("kind") == "L", F.col("s")).alias("name"),
        F.when(F.col("kind") == "P", F.col("b")).alias("grp"), F.when(F.col("kind") == "P", F.col("c")).alias("part"), F.when(F.col("kind") == "P", F.col("e")).alias("worker"),
        F.when(stat, F.col("a")).alias("stage"), F.when(stat, F.col("b")).alias("stmt"), F.when(stat, F.col("v")).alias("value"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log file, whole, so that its lines keep their order."""
    whole = spark.read.text(path, wholetext=True)
    return parse(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.trim("line") != ""))


def last_session(log: DataFrame) -> DataFrame:
    return log.join(F.broadcast(log.agg(F.max("session").alias("session"))), "session")


def cycle_sums(cycles: DataFrame) -> DataFrame:
    """``stmt, stage, cycles``."""
    return cycles.groupBy("stmt", "stage").agg(F.sum("value").alias("cycles"))


def mean_cycles(cycles: DataFrame) -> DataFrame:
    """The mean over a statement's stages but the first and last; none with under three stages."""
    sums = cycle_sums(cycles)
    w = Window.partitionBy("stmt")
    inner = sums.withColumn("lo", F.min("stage").over(w)).withColumn("hi", F.max("stage").over(w)).where("stage > lo and stage < hi")
    return inner.groupBy("stmt").agg(F.count("*").alias("stages"), F.avg("cycles").alias("mean"))


def intervals(stamps: DataFrame) -> DataFrame:
    """Gaps between a statement's timestamps but the first and last: least, most, third of either end, mean, upper median."""
    w = Window.partitionBy("stmt").orderBy("stage")
    n = F.count("*").over(Window.partitionBy("stmt"))
    inner = stamps.withColumn("i", F.row_number().over(w)).withColumn("n", n).where("i > 1 and i < n")
    gaps = inner.withColumn("gap", F.col("value") - F.lag("value").over(w)).where("gap is not null")
    g = gaps.groupBy("stmt").agg(F.array_sort(F.collect_list("gap")).alias("g"), F.avg("gap").alias("mean"))
    size = F.size("g")
    return g.select("stmt", size.cast("long").alias("gaps"), F.col("g")[0].alias("least"), F.get("g", size - 1).alias("most"), F.get("g", F.lit(2)).alias("third_least"), F.get("g", size - 3).alias("third_most"), "mean", F.get("g", F.floor(size / 2).cast("int")).alias("median"))


def partition_counts(parts: DataFrame) -> DataFrame:
    """``parts`` (the most partitions in a group) and ``workers``, over all."""
    per = parts.groupBy("grp").agg(F.countDistinct("part").alias("n"))
    return per.agg(F.max("n").alias("parts")).join(F.broadcast(parts.agg(F.countDistinct("worker").alias("workers"))), F.lit(True))
