"""Particle files: little-endian float32 particles per metre, int32 count, then nine float32 a particle (p, half-step v, v)."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAMES = ("x", "y", "z", "hx", "hy", "hz", "vx", "vy", "vz")
SCHEMA = "id long, per_metre float, " + ", ".join(f"{n} float" for n in NAMES)
CHUNK = 200_000


class FluidSource(DataSource):
    """``spark.read.format("fluid").load(path)`` after ``spark.dataSource.register(FluidSource)``; a task reads a range of particles."""

    @classmethod
    def name(cls) -> str:
        return "fluid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with open(self.path, "rb") as f:
            _, n = struct.unpack("<fi", f.read(8))
        if os.path.getsize(self.path) < 8 + 36 * n:
            raise ValueError(f"{self.path} ends before its {n} particles")
        return [InputPartition((at, min(CHUNK, n - at))) for at in range(0, n, CHUNK)] or [InputPartition((0, 0))]

    def read(self, partition) -> Iterator:
        import pyarrow as pa

        at, n = partition.value
        with open(self.path, "rb") as f:
            per_metre, _ = struct.unpack("<fi", f.read(8))
            f.seek(8 + 36 * at)
            rows = np.frombuffer(f.read(36 * n), "<f4").reshape(n, 9)
        cols = [pa.array(np.arange(at, at + n, dtype=np.int64)), pa.array(np.full(n, per_metre, np.float32))] + [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(9)]
        yield pa.RecordBatch.from_arrays(cols, ["id", "per_metre", *NAMES])


def write(df: DataFrame, path: str, per_metre: float) -> None:
    """One file, in the order of ids; rows pass through the driver a batch at a time, as the format has one header."""
    with open(path, "wb") as f:
        f.write(struct.pack("<fi", per_metre, df.count()))
        for r in df.orderBy("id").select(*NAMES).toLocalIterator(prefetchPartitions=True):
            f.write(struct.pack("<9f", *r))
