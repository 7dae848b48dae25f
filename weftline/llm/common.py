"""What the operators share: passing batches of texts to Python in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.session import prepare

#: Texts are taken from Arrow batches in runs of at most so many rows and characters (one text at least).
RUN_ROWS, RUN_CHARS = 256, 4_000_000
#: Keys with more rows than this are joined on their own; tables of at most so many row keys are broadcast (about 100 MB).
HOT, BROADCAST_ROWS = 1_000_000, 1_000_000


def runs(batch: pa.RecordBatch, text: int = 1) -> Iterator[list[tuple]]:
    """Rows of a batch as lists of tuples, cut so that a list's texts stay small."""
    for at in range(0, batch.num_rows, RUN_ROWS):
        part = batch.slice(at, RUN_ROWS)
        rows, size = [], 0
        for row in zip(*(c.to_pylist() for c in part.columns)):
            rows.append(row)
            size += len(row[text] or "")
            if size >= RUN_CHARS:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most RUN_ROWS rows whose texts have some RUN_CHARS bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    lo = size = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= RUN_ROWS or size + n > RUN_CHARS):
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lo < len(sizes):
        yield batch.slice(lo)


def map_rows(df: DataFrame, fn: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]], schema: str, text: int = 1) -> DataFrame:
    """``fn`` turns lists of row tuples into lists of row tuples, task by task, with no shuffle."""
    prepare(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for rows in fn(r for b in batches for r in runs(b, text)):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text ``make()`` (called once a task) says true to; all columns stay, nothing is shuffled."""
    prepare(df.sparkSession)

    def run(batches):
        keep = make()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in slices(batch, at):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bucket(column, n: int):
    """crc32(column as text) mod n; null where the column is null."""
    return F.crc32(column.cast("string")) % n


def medians(df: DataFrame, group: str, value: str, most: int = 100_000, cells: int = 1 << 14) -> dict:
    """The exact median of ``value`` (finite doubles) by ``group``, of all rows; rows with a null in either don't count.

    The values between which a median lies are counted in cells, and the cell that holds it is cut again, until ``most`` rows
    are left in all; only those come to the driver, and counts of some ``cells`` cells a pass (two a group at least).
    """
    df = df.select(F.col(group).alias("g"), F.col(value).alias("x")).where("g is not null and x is not null")
    out: dict = {}
    # by group: least and most of the values left, how many, and the places of the two middle ones among them
    left = {r.g: (r.lo, r.hi, r.n, (r.n - 1) // 2, r.n // 2) for r in df.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect()}
    while True:
        out |= {g: lo for g, (lo, hi, *_) in left.items() if lo == hi}
        left = {g: v for g, v in left.items() if v[0] < v[1]}
        if not left:
            return out
        k = max(2, cells // len(left))
        bounds = F.broadcast(df.sparkSession.createDataFrame([(g, lo, hi) for g, (lo, hi, *_) in left.items()], "g string, lo double, hi double"))
        rows = df.join(bounds, "g").where("x >= lo and x <= hi")
        if sum(v[2] for v in left.values()) <= most:
            found: dict = {}
            for r in rows.select("g", "x").collect():
                found.setdefault(r.g, []).append(r.x)
            for g, (_, _, _, a, b) in left.items():
                own = sorted(found[g])
                out[g] = (own[a] + own[b]) / 2
            return out
        # halves, so that the width of no range overflows; the least value is in the first cell and the largest in the last
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("x") == F.col("lo"), F.lit(0)).when(F.col("x") == F.col("hi"), F.lit(k - 1)).otherwise(F.least(F.floor(share * k), F.lit(k - 1)))
        cut: dict = {}
        for r in rows.groupBy("g", cell.alias("cell")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).collect():
            cut.setdefault(r.g, []).append((r.cell, r.lo, r.hi, r.n))
        for g, (_, _, _, a, b) in list(left.items()):
            for _, lo, hi, n in sorted(cut[g]):
                if b < n:
                    left[g] = lo, hi, n, a, b
                    break
                if a < n:  # the last of this cell and the first of the next
                    out[g] = (hi + min(x[1] for x in cut[g] if x[1] > hi)) / 2
                    del left[g]
                    break
                a, b = a - n, b - n


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], n: str, rows: int | None = None, hot: int | None = None, near: int = 0) -> DataFrame:
    """Inner join of ``big`` with ``small``, whose keys are unique and whose column ``n`` says how many rows of ``big`` have each.

    Keys with over ``hot`` (HOT) rows don't meet in one task: they are broadcast, and their rows stay where they
    are. There are at most 20,000 such keys, since ``hot`` grows with the rows. ``rows``: at most so many rows in ``big``, if known.
    ``near``: if ``small`` has so many rows at most, it is broadcast, and nothing is shuffled.
    """
    hot = HOT if hot is None else hot
    if not near and rows is not None and rows <= hot:
        return big.join(small, keys)
    size, total, top = small.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if size <= near:
        return big.join(F.broadcast(small), keys)
    least = max(hot, total // 20_000)
    if top <= least:
        return big.join(small, keys)
    few = F.broadcast(big.sparkSession.createDataFrame(small.where(F.col(n) > least).collect(), small.schema))
    rest = big.join(few.select(keys), keys, "left_anti").join(small.where(F.col(n) <= least), keys)
    return big.join(few, keys).unionByName(rest)


def row_key(df: DataFrame) -> list:
    """Two 64-bit hashes over all columns of a row, as columns ``k1`` and ``k2``: rows alike in all columns share them."""
    own = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        own += [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c, c.isNull()]
    return [F.xxhash64(*own).alias("k1"), F.xxhash64(F.lit("second"), *own).alias("k2")]


def without(df: DataFrame, drop: DataFrame, repeated: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """``df`` without the rows whose row_key() is in ``drop``, and with one row of each key in ``repeated``.

    Up to ``most`` (BROADCAST_ROWS) keys are broadcast, so that ``df`` isn't shuffled; beyond that it's a join. Of
    repeated rows only those that repeat are shuffled, after one of each is left in every task.
    """
    most = BROADCAST_ROWS if most is None else most
    names, taken = [], {c.lower() for c in df.columns}
    for k in ("k1", "k2"):
        name = f"row_{k}"
        while name in taken:
            name += "_"
        names.append(name)
    a, b = row_key(df)
    full = df.select("*", a.alias(names[0]), b.alias(names[1]))
    small = lambda x: x.select(F.col("k1").alias(names[0]), F.col("k2").alias(names[1]))
    near = lambda x: F.broadcast(x) if x.count() <= most else x
    gone = drop.select("k1", "k2")
    again = repeated.select("k1", "k2") if repeated is not None and not repeated.isEmpty() else None
    out = full.join(near(small(gone.union(again) if again is not None else gone)), names, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    if again is not None:
        one = full.join(near(small(again)), names, "left_semi").dropDuplicates(names)
        out = out.union(one.select(*(F.col(f"`{c}`") for c in df.columns)))
    return out
