"""Vector algebra on array columns (any length) and on x, y, z structs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths under this are taken for zero by p3_unit.
TINY = 1e-12


def vadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vsub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vacc(a: Column, k: Column, b: Column) -> Column:
    """a + k b."""
    return F.zip_with(a, b, lambda x, y: x + k * y)


def vscale(k: Column, a: Column) -> Column:
    return F.transform(a, lambda x: k * x)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def vdot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def vsquare(a: Column) -> Column:
    return _total(F.transform(a, lambda x: x * x))


def vdist2(a: Column, b: Column) -> Column:
    """The squared distance."""
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def p3(x, y, z) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def p3_map(op, *points: Column) -> Column:
    """A point whose components are ``op`` of the given points' components."""
    return p3(*(op(*(p[c] for p in points)) for c in "xyz"))


def p3_dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def p3_dist2(a: Column, b: Column) -> Column:
    d = p3_map(lambda x, y: x - y, a, b)
    return p3_dot(d, d)


def p3_length(a: Column) -> Column:
    return F.sqrt(p3_dot(a, a))


def p3_unit(a: Column) -> Column:
    """Length 1; as it is if its length is next to nothing."""
    n = p3_length(a)
    return p3_map(lambda x: F.when(n > TINY, x / n).otherwise(x), a)


def p3_lerp(a: Column, b: Column, t: Column) -> Column:
    return p3_map(lambda x, y: x + (y - x) * t, a, b)


def p3_product(a: Column) -> Column:
    return a["x"] * a["y"] * a["z"]


def p3_text(a: Column) -> Column:
    return F.concat_ws(" ", a["x"].cast("string"), a["y"].cast("string"), a["z"].cast("string"))


def p3_parse(s: Column) -> Column:
    parts = F.split(F.trim(s), r"\s+")
    return p3(*(F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3)))


def sign(x: Column) -> Column:
    """-1 under zero, else 1: zero counts as positive."""
    return F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def long_form(df, vector: str, *keys: str, value: str = "x"):
    """One row a component: keys, ``dim`` (from 0, long) and ``value``."""
    return df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("dim", value)).withColumn("dim", F.col("dim").cast("long"))
