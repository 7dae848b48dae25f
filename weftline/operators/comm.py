"""Scatter, gather, broadcast and reduce between the partitions of a group, as DataFrame operations.

A partition is a value of a column (``part``), never a physical Spark partition, so results don't depend
on how Spark splits the data.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scatter(df: DataFrame, to: Column, **payload: Column) -> DataFrame:
    """Messages: ``dst`` and the payload columns."""
    return df.select(to.cast("long").alias("dst"), *(c.alias(k) for k, c in payload.items()))


def ordered_scatter(df: DataFrame, to: Column, sender: Column, **payload: Column) -> DataFrame:
    """As scatter(), with the sender's id in ``src``."""
    return df.select(to.cast("long").alias("dst"), sender.alias("src"), *(c.alias(k) for k, c in payload.items()))


def gather(messages: DataFrame, parts: int, *aggs: Column) -> DataFrame:
    """One row for each of ``parts`` partitions, those without messages too: ``part`` and the aggregates (null there)."""
    inbox = messages.groupBy("dst").agg(*aggs)
    group = messages.sparkSession.range(parts).withColumnRenamed("id", "part")
    return group.join(inbox, group["part"] == inbox["dst"], "left").drop("dst")


def gather_list(messages: DataFrame, value: str) -> DataFrame:
    """All payloads by ``dst``, sorted, since their arrival has no order."""
    return messages.groupBy("dst").agg(F.array_sort(F.collect_list(value)).alias("inbox"))


def ordered_gather(messages: DataFrame, value: str) -> DataFrame:
    """Payloads by ``dst`` in the order of senders; of two from one sender the greater payload stays."""
    one = messages.groupBy("dst", "src").agg(F.max(value).alias(value))
    return one.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("src", value))), lambda s: s[value]).alias("inbox"))


def gather_single(messages: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """The payload of partitions that must have had exactly one message; others raise an error. Of ``parts`` partitions (if given) none may have had none."""
    got = messages.groupBy("dst").agg(F.count("*").alias("n"), F.max(value).alias(value))
    if parts is not None:
        got = messages.sparkSession.range(parts).select(F.col("id").alias("dst")).join(got.withColumn("dst", F.col("dst").cast("long")), "dst", "full")
    told = F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" messages instead of one (not more than one message, not none) for partition "), F.col("dst").cast("string"))
    checked = F.when(F.col("n") == 1, F.col(value)).otherwise(F.raise_error(told))
    return got.select("dst", checked.alias(value))


def missing(messages: DataFrame, parts: int, expected: int) -> DataFrame:
    """How many messages each partition still waits for: ``part, got, missing``."""
    got = gather(messages, parts, F.count("*").alias("got"))
    return got.select("part", F.coalesce("got", F.lit(0)).cast("long").alias("got"), (F.lit(expected) - F.coalesce("got", F.lit(0))).cast("long").alias("missing"))


def broadcast_value(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a row that is the only one (an aggregate without keys)."""
    return df.crossJoin(F.broadcast(one_row))


def tree_reduce(df: DataFrame, part: str, fan: int, partial: Iterable[Column], final: Iterable[Column]) -> DataFrame:
    """Two levels: by ``part`` mod ``fan``, then all. Spark's own partial aggregation makes it rarely needed."""
    first = df.groupBy(F.pmod(F.col(part), F.lit(fan)).alias("layer")).agg(*partial)
    return first.agg(*final)


def all_reduce(df: DataFrame, *aggs: Column) -> DataFrame:
    """``df`` with the aggregates of all its rows; one reduction and a one-row broadcast."""
    return broadcast_value(df, df.agg(*aggs))


def all_gather(senders: DataFrame, parts: int, value: str) -> DataFrame:
    """Every sender's payload at every of ``parts`` partitions: ``part, src, value``. The senders are a group's partitions, one row each."""
    group = senders.sparkSession.range(parts).withColumnRenamed("id", "part")
    return senders.select("src", value).join(F.broadcast(group), F.lit(True)).select("part", "src", value)


def upsert_where(df: DataFrame, received: DataFrame, key: str, target: str, value: str, replace: Column) -> DataFrame:
    """``target`` becomes the received ``value`` where ``replace`` holds and something was received."""
    got = received.select(F.col(key), F.col(value).alias("__got"))
    out = df.join(got, key, "left")
    return out.withColumn(target, F.when(replace & F.col("__got").isNotNull(), F.col("__got")).otherwise(F.col(target))).drop("__got")
