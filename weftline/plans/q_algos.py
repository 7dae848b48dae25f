"""Queries for graph ranking, clustering, regression and stencils."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import vec
from weftline.operators import clustering, ranking, regression, stencil
from weftline.plans.catalogue import register
from weftline.plans.q_comm import EVENT_CELLS, event_cells
from weftline.session import table

# graph ranking -----------------------------------------------------------------------------------


def bipartite_edges(spark, d):
    """Customers and suppliers (as -1 - key) linked by an order line, both ways."""
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


_PAIRS = "p as (select distinct o_custkey as a, -1 - l_suppkey as b from orders join lineitem on o_orderkey = l_orderkey), e as (select a as src, b as dst from p union all select b, a from p)"


def _walk_sql(edges: str, trips: int, tail: str) -> str:
    parts = [edges, "d as (select src, count(*)::double as deg from e group by 1)", "r0 as (select src as v, 1.0::double as rank from d)"]
    for k in range(trips):
        parts.append(f"r{k + 1} as (select r.v, 0.85::double * r.rank + 0.15::double * coalesce(i.s, 0) as rank from r{k} r left join (select e.dst, sum(q.rank / d.deg) as s from e join r{k} q on q.v = e.src join d on d.src = e.src group by 1) i on i.dst = r.v)")
    return f"with {', '.join(parts)} {tail.replace('@', f'r{trips}')}"


@register("pagerank_bipartite", _walk_sql(_PAIRS, 3, "select v, round(rank, 6) as rank from @"))
def pagerank_bipartite(spark, d):
    return ranking.walk(bipartite_edges(spark, d), 3, both_ways=True).select("v", F.round("rank", 6).alias("rank"))


@register("pagerank_total", _walk_sql(_PAIRS, 3, "select count(*)::bigint as vertices, round(sum(rank), 4) as total from @"))
def pagerank_total(spark, d):
    return ranking.walk(bipartite_edges(spark, d), 3, both_ways=True).agg(F.count("*").alias("vertices"), F.round(F.sum("rank"), 4).alias("total"))


_MESH = """g as (select (range // 4)::bigint as x, (range % 4)::bigint as y from range(16)), e as (select a.x * 4 + a.y as src, b.x * 4 + b.y as dst from g a join g b on abs(a.x - b.x) + abs(a.y - b.y) = 1)"""


@register("pagerank_mesh", _walk_sql(_MESH, 10, "select v, round(rank, 6) as rank from @"))
def pagerank_mesh(spark, d):
    return ranking.walk(ranking.mesh_edges(spark, 4, 4), 10, both_ways=True).select("v", F.round("rank", 6).alias("rank"))


@register("edge_owners", "with p as (select distinct o_custkey as a, l_suppkey as b from orders join lineitem on o_orderkey = l_orderkey) select least(least(a, b) // 12, 7)::bigint as part, count(*)::bigint as edges from p group by 1")
def edge_owners(spark, d):
    pairs = bipartite_edges(spark, d).where("dst < 0").select(F.col("src").alias("a"), (-1 - F.col("dst")).alias("b"))
    return pairs.groupBy(ranking.edge_owner(F.col("a"), F.col("b"), 100, 8).alias("part")).agg(F.count("*").alias("edges"))


@register("out_degrees", f"with {_PAIRS} select src as v, count(*)::bigint as deg from e group by 1")
def out_degrees(spark, d):
    return bipartite_edges(spark, d).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))


# clustering --------------------------------------------------------------------------------------


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec.doubles(F.col("embedding")).alias("v"), "label")


def _start(points):
    """The means by label, as the first centres."""
    return clustering.move(points.select(F.col("label").cast("long").alias("c"), "v"), points.select(F.col("label").cast("long").alias("c")).distinct().withColumn("m", F.array().cast("array<double>")))


_L = "l as (select vec_id as id, label, (generate_subscripts(embedding, 1) - 1) as i, unnest(embedding)::double as x from embeddings)"


def _kmeans_sql(trips: int, tail: str, extra: str = "") -> str:
    parts = [_L, f"m0 as (select label::bigint as c, i, avg(x) as m from l group by 1, 2{extra})"]
    for k in range(trips):
        parts.append(f"a{k} as (select id, c, d2 from (select l.id, m.c, round(sum((l.x - m.m) * (l.x - m.m)), 9) as d2, row_number() over (partition by l.id order by round(sum((l.x - m.m) * (l.x - m.m)), 9), m.c) as rn from l join m{k} m on m.i = l.i group by 1, 2) where rn = 1)")
        parts.append(f"m{k + 1} as (select m.c, m.i, coalesce(n.m, m.m) as m from m{k} m left join (select a.c, l.i, sum(l.x) / count(*) as m from a{k} a join l on l.id = a.id group by 1, 2) n on n.c = m.c and n.i = m.i)")
    return f"with {', '.join(parts)} {tail.replace('@a', f'a{trips - 1}').replace('@m', f'm{trips}')}"


def _centres(df):
    return df.select("c", F.posexplode("m").alias("dim", "x")).select("c", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@register("kmeans_assign", _kmeans_sql(1, "select id, c, round(d2, 6) as d2 from @a"))
def kmeans_assign(spark, d):
    p = _points(spark, d)
    return clustering.assign(p, _start(p)).select("id", "c", F.round("d2", 6).alias("d2"))


@register("kmeans_centers", _kmeans_sql(3, "select c, i::bigint as dim, round(m, 6) as x from @m"))
def kmeans_centers(spark, d):
    p = _points(spark, d)
    return _centres(clustering.kmeans(p, _start(p), 3))


@register("kmeans_empty_cluster", _kmeans_sql(2, "select c, i::bigint as dim, round(m, 6) as x from @m", " union all select 99, i, 1000.0::double from (select distinct i from l)"))
def kmeans_empty_cluster(spark, d):
    p = _points(spark, d)
    far = p.agg(F.max(F.size("v")).alias("n")).select(F.lit(99).cast("long").alias("c"), F.expr("array_repeat(1000.0D, n)").alias("m"))
    return _centres(clustering.kmeans(p, _start(p).unionByName(far), 2))


# regression --------------------------------------------------------------------------------------


def _samples(spark, d):
    x = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(1.0))
    return table(spark, d, "lineitem").select(x.alias("x"), (F.col("l_returnflag") == "R").alias("y"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("pm"))


_X = ["l_quantity / 50", "l_extendedprice / 100000", "l_discount * 10", "l_tax * 10", "1.0::double"]


def _logreg_sql(trips: int, w0: float, rate: str, tail: str, pm: bool = False) -> str:
    x = ", ".join(f"{e} as x{i}" for i, e in enumerate(_X))
    parts = [f"s as (select {x}, (case when l_returnflag = 'R' then 1 else 0 end)::double as y, (case when l_returnflag = 'R' then 1 else -1 end)::double as pm from lineitem)", f"k as (select ({rate})::double as r)", "w0 as (select " + ", ".join(f"{w0}::double as w{i}" for i in range(5)) + ")"]
    dot = " + ".join(f"w{i} * x{i}" for i in range(5))
    f = f"pm * (1 / (1 + exp(-pm * ({dot}))) - 1)" if pm else f"1 / (1 + exp(-({dot}))) - y"
    for t in range(trips):
        parts.append(f"g{t} as (select " + ", ".join(f"sum(({f}) * x{i}) as g{i}" for i in range(5)) + f" from s, w{t})")
        parts.append(f"w{t + 1} as (select " + ", ".join(f"w{i} - r * g{i} as w{i}" for i in range(5)) + f" from w{t}, g{t}, k)")
    return f"with {', '.join(parts)} " + " union all ".join(tail.replace("#", str(i)).replace("@", str(trips)) for i in range(5))


def _weights(spark, w, name="w"):
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(w)], f"dim long, {name} double")


@register("logreg_gradient", _logreg_sql(1, 0.0, "1", "select #::bigint as dim, round(g#, 4) as g from g0"))
def logreg_gradient(spark, d):
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(regression.gradient(_samples(spark, d), [0.0] * 5))], "dim long, g double")


def _rate(samples, k):
    return k / samples.count()


_N = "(select count(*) from lineitem)"


@register("logreg_loop", _logreg_sql(5, 0.0, f"2.0::double / {_N}", "select #::bigint as dim, round(w#, 6) as w from w@"))
def logreg_loop(spark, d):
    s = _samples(spark, d)
    return _weights(spark, regression.fit(s, [0.0] * 5, 5, _rate(s, 2.0)))


@register("logreg_pm1", _logreg_sql(3, 1.0, f"2.0::double / {_N}", "select #::bigint as dim, round(w#, 6) as w from w@", pm=True))
def logreg_pm1(spark, d):
    s = _samples(spark, d)
    return _weights(spark, regression.fit(s.withColumn("y", F.col("pm")), [1.0] * 5, 3, _rate(s, 2.0), plus_minus=True))


@register("while_converge", _logreg_sql(4, 1.0, f"2.0::double / {_N}", "select #::bigint as dim, round(w#, 6) as w, 4::bigint as trips from w@"))
def while_converge(spark, d):
    s = _samples(spark, d)
    w, trips = regression.fit_while(s, [1.0] * 5, _rate(s, 2.0), 0.001)
    return _weights(spark, w).withColumn("trips", F.lit(trips).cast("long"))


# stencils ----------------------------------------------------------------------------------------


@register("stencil_events_2d", f"with c as ({EVENT_CELLS}) select a.x, a.y, round(avg(b.v), 4) as v from c a join c b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2")
def stencil_events_2d(spark, d):
    return stencil.box_average(event_cells(spark, d), ["x", "y"]).select("x", "y", F.round("v", 4).alias("v"))


def _cube_sql(trips: int, tail: str) -> str:
    parts = ["c0 as (select (range % 10)::bigint as ix, (range // 10 % 10)::bigint as iy, (range // 100)::bigint as iz, (range % 10 + range // 10 % 10 + range // 100)::double as v from range(1000))"]
    for k in range(trips):
        parts.append(f"c{k + 1} as (select a.ix, a.iy, a.iz, avg(b.v) as v from c{k} a join c{k} b on b.ix between a.ix - 1 and a.ix + 1 and b.iy between a.iy - 1 and a.iy + 1 and b.iz between a.iz - 1 and a.iz + 1 group by 1, 2, 3)")
    return f"with {', '.join(parts)} {tail.replace('@', f'c{trips}')}"


@register("stencil_3d", _cube_sql(3, "select ix, iy, iz, round(v, 6) as v from @"))
def stencil_3d(spark, d):
    return stencil.smooth(stencil.cube(spark, 10, 10, 10), ["ix", "iy", "iz"], 3).select("ix", "iy", "iz", F.round("v", 6).alias("v"))


@register("stencil_checksum", _cube_sql(3, "select round(sum(v), 4) as checksum, (10 * 10 * 10 * 27 / 2)::double as closed_form from @"))
def stencil_checksum(spark, d):
    g = stencil.smooth(stencil.cube(spark, 10, 10, 10), ["ix", "iy", "iz"], 3)
    return g.agg(F.round(F.sum("v"), 4).alias("checksum")).withColumn("closed_form", F.lit(10 * 10 * 10 * (10 + 10 + 10 - 3) / 2))
