"""Sessions, and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
ROOT = str(Path(__file__).resolve().parents[1])


def local_session(name: str, cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that every query here expects (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that checkpoints have a folder.

    The folder is the one the session names in spark.checkpoint.dir. Only where neither that nor
    setCheckpointDir was given, and only in local mode, a temporary folder serves.
    """
    sc = spark.sparkContext
    if ROOT not in sc.environment.get("PYTHONPATH", "").split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, sc.environment.get("PYTHONPATH", "")) if x)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="weftline-checkpoints-")
        sc.setCheckpointDir(where)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there: its lineage ends, and no executor's loss undoes it."""
    prepare(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """As checkpoint(), but as a compressed Parquet table, of which later passes read the columns they need; see release()."""
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> int:
    """Delete the tables that written() made in this process, once no DataFrame needs them; returns how many."""
    n = 0
    while _written:
        remove(spark, _written.pop())
        n += 1
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
