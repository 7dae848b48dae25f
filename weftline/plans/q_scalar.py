"""Queries for vector, point and grid functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import grid, vec
from weftline.plans.catalogue import register
from weftline.session import table

_E = "embedding::double[]"


def _vectors(spark, d):
    a = vec.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", a.alias("a"), F.reverse(a).alias("b"))


def _rows(df, c):
    return df.select("vec_id", F.posexplode(c).alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("v", 6).alias("v"))


def _sql(expr):
    return f"""select vec_id, (generate_subscripts(a, 1) - 1)::bigint as dim, round(unnest(list_transform(list_zip(a, b), lambda p: {expr})), 6) as v
from (select vec_id, {_E} as a, list_reverse({_E}) as b from embeddings)"""


@register("vec_add", _sql("p[1] + p[2]"))
def vec_add(spark, d):
    return _rows(_vectors(spark, d), vec.vadd(F.col("a"), F.col("b")))


@register("vec_sub", _sql("p[1] - p[2]"))
def vec_sub(spark, d):
    return _rows(_vectors(spark, d), vec.vsub(F.col("a"), F.col("b")))


@register("vec_acc", _sql("p[1] + 2.5::double * p[2]"))
def vec_acc(spark, d):
    return _rows(_vectors(spark, d), vec.vacc(F.col("a"), F.lit(2.5), F.col("b")))


@register("vec_mul", _sql("1.5::double * p[1]"))
def vec_mul(spark, d):
    return _rows(_vectors(spark, d), vec.vscale(F.lit(1.5), F.col("a")))


def _scalar(name, sql, fn):
    @register(name, f"select vec_id, round({sql}, 6) as v from (select vec_id, {_E} as a, list_reverse({_E}) as b from embeddings)")
    def run(spark, d):
        return _vectors(spark, d).select("vec_id", F.round(fn(F.col("a"), F.col("b")), 6).alias("v"))


_scalar("vec_dot", "list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2]))", vec.vdot)
_scalar("vec_sq", "list_sum(list_transform(a, lambda x: x * x))", lambda a, b: vec.vsquare(a))
_scalar("vec_dist", "list_sum(list_transform(list_zip(a, b), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", vec.vdist2)
_scalar("sigmoid", "1 / (1 + exp(-a[1]))", lambda a, b: vec.sigmoid(a[0]))
_scalar("sign_of", "(case when a[1] < 0 then -1 else 1 end)::double", lambda a, b: vec.sign(a[0]).cast("double"))

_P = f"(select vec_id, a[1] as ax, a[2] as ay, a[3] as az, a[4] as bx, a[5] as by_, a[6] as bz from (select vec_id, {_E} as a from embeddings))"


@register("point_algebra", f"""select vec_id, round(ax * bx + ay * by_ + az * bz, 6) as dot, round((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2, 6) as dist2,
round(sqrt(ax * ax + ay * ay + az * az), 6) as length, round(ax / sqrt(ax * ax + ay * ay + az * az), 6) as unit_x, round(ax + (bx - ax) * 0.25, 6) as lerp_x, round(ax * ay * az, 6) as product from {_P}""")
def point_algebra(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", vec.doubles(F.col("embedding")).alias("e"))
    p = p.select("vec_id", vec.p3(*(F.col("e")[i] for i in range(3))).alias("a"), vec.p3(*(F.col("e")[i] for i in range(3, 6))).alias("b"))
    a, b = F.col("a"), F.col("b")
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.select("vec_id", r(vec.p3_dot(a, b), "dot"), r(vec.p3_dist2(a, b), "dist2"), r(vec.p3_length(a), "length"), r(vec.p3_unit(a)["x"], "unit_x"), r(vec.p3_lerp(a, b, F.lit(0.25))["x"], "lerp_x"), r(vec.p3_product(a), "product"))


@register("point_text", "select s_suppkey, s_nationkey::double as x, s_suppkey::double as y, (s_suppkey % 7)::double as z from supplier")
def point_text(spark, d):
    p = table(spark, d, "supplier").select("s_suppkey", vec.p3(F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double"), (F.col("s_suppkey") % 7).cast("double")).alias("p"))
    back = p.select("s_suppkey", vec.p3_parse(vec.p3_text(F.col("p"))).alias("q"))
    return back.select("s_suppkey", "q.x", "q.y", "q.z")


@register("grid_rank_roundtrip", "select range::bigint as r, (range % 6)::bigint as ix, (range // 6 % 5)::bigint as iy, (range // 30)::bigint as iz, range::bigint as back from range(120)")
def grid_rank_roundtrip(spark, d):
    ix, iy, iz = grid.index(F.col("id"), 6, 5)
    g = spark.range(120).select(F.col("id").alias("r"), ix.alias("ix"), iy.alias("iy"), iz.alias("iz"))
    return g.withColumn("back", grid.rank(F.col("ix"), F.col("iy"), F.col("iz"), 6, 5))


@register("grid_subgrid_bounds", """select range::bigint as part, greatest(range * 6 + least(range, 5) - 1, 0)::bigint as lo, least(range * 6 + least(range, 5) + 6 + (case when range < 5 then 1 else 0 end) + 1, 53)::bigint as hi from range(8)""")
def grid_subgrid_bounds(spark, d):
    lo, hi = grid.bounds(F.col("id"), 53, 8, ghost=1)
    return spark.range(8).select(F.col("id").alias("part"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


@register("grid_clamp_cell", "select c_custkey, least(greatest(floor((c_acctbal - 0) / 500), 0), 9)::bigint as cell, c_acctbal >= 0 and c_acctbal < 5000 as inside from customer")
def grid_clamp_cell(spark, d):
    return table(spark, d, "customer").select("c_custkey", grid.cell(F.col("c_acctbal"), 0.0, 500.0, 10).cast("long").alias("cell"), grid.contains(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0)).alias("inside"))


@register("grid_neighbors", """with g as (select (range % 4)::bigint as ix, (range // 4 % 3)::bigint as iy, (range // 12)::bigint as iz from range(24))
select a.ix, a.iy, a.iz, count(*)::bigint as neighbours from g a join g b on abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1 and abs(a.iz - b.iz) <= 1 and (a.ix, a.iy, a.iz) <> (b.ix, b.iy, b.iz) group by 1, 2, 3""")
def grid_neighbors(spark, d):
    ix, iy, iz = grid.index(F.col("id"), 4, 3)
    g = spark.range(24).select(ix.cast("long").alias("ix"), iy.cast("long").alias("iy"), iz.cast("long").alias("iz"))
    n = grid.with_neighbours(g, ["ix", "iy", "iz"], centre=False)
    inside = grid.contains(F.col("nix"), F.lit(0), F.lit(4)) & grid.contains(F.col("niy"), F.lit(0), F.lit(3)) & grid.contains(F.col("niz"), F.lit(0), F.lit(2))
    return n.where(inside).groupBy("ix", "iy", "iz").agg(F.count("*").alias("neighbours"))
