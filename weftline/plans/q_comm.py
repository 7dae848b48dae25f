"""Queries for the statements, the communication primitives and their patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import grid, vec
from weftline.operators import comm
from weftline.operators.iterate import loop
from weftline.plans.catalogue import register
from weftline.session import table

N = "::bigint"


@register("transform_map", "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem")
def transform_map(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@register("transform_group", """select o_orderkey, o_orderstatus, count(*)::bigint as lines, sum(l_quantity) as quantity, round(sum(l_extendedprice), 2) as price
from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus""")
def transform_group(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@register("scatter_unicast", "select (l_suppkey % 8)::bigint as part, count(*)::bigint as messages, sum(l_quantity) as quantity from lineitem group by 1")
def scatter_unicast(spark, d):
    sent = comm.scatter(table(spark, d, "lineitem"), F.col("l_suppkey") % 8, q=F.col("l_quantity"))
    return comm.gather(sent, 8, F.count("*").alias("messages"), F.sum("q").alias("quantity"))


@register("broadcast_global", "select l_returnflag, count(*)::bigint as above from lineitem where l_quantity > (select avg(l_quantity) from lineitem) group by 1")
def broadcast_global(spark, d):
    t = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    return comm.broadcast_value(t, t.agg(F.avg("l_quantity").alias("mean"))).where("l_quantity > mean").groupBy("l_returnflag").agg(F.count("*").alias("above"))


@register("gather_list", "select s_nationkey::bigint as part, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as inbox from supplier group by 1")
def gather_list(spark, d):
    sent = comm.scatter(table(spark, d, "supplier"), F.col("s_nationkey"), key=F.col("s_suppkey"))
    return comm.gather_list(sent, "key").select(F.col("dst").alias("part"), F.array_join(F.col("inbox").cast("array<string>"), ",").alias("inbox"))


@register("gather_single", "select n_nationkey::bigint as part, r_name as payload from nation join region on n_regionkey = r_regionkey")
def gather_single(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    sent = comm.scatter(n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]), F.col("n_nationkey"), payload=F.col("r_name"))
    return comm.gather_single(sent, "payload", 25).withColumnRenamed("dst", "part")


@register("ordered_gather", "select conv_id::bigint as part, string_agg(role || ':' || length(text), ',' order by turn) as inbox from conversations group by 1")
def ordered_gather(spark, d):
    sent = comm.ordered_scatter(table(spark, d, "conversations"), F.col("conv_id"), F.col("turn"), said=F.concat_ws(":", "role", F.length("text").cast("string")))
    return comm.ordered_gather(sent, "said").select(F.col("dst").alias("part"), F.array_join("inbox", ",").alias("inbox"))


@register("gather_expect_audit", """select p.range::bigint as part, count(s_suppkey)::bigint as got, (4 - count(s_suppkey))::bigint as missing
from range(32) p left join supplier on s_suppkey % 32 = p.range group by 1""")
def gather_expect_audit(spark, d):
    return comm.missing(comm.scatter(table(spark, d, "supplier"), F.col("s_suppkey") % 32), 32, 4)


@register("reduce_sum", "select count(*)::bigint as n, sum(l_quantity) as quantity, round(sum(l_extendedprice), 2) as price from lineitem")
def reduce_sum(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@register("reduce_min", "select l_returnflag, min(l_extendedprice) as least from lineitem group by 1")
def reduce_min(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("least"))


@register("reduce_max", "select l_returnflag, max(l_extendedprice) as most from lineitem group by 1")
def reduce_max(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_extendedprice").alias("most"))


@register("reduce_minmax4", "select min(l_quantity) as lo_q, max(l_quantity) as hi_q, min(l_extendedprice) as lo_p, max(l_extendedprice) as hi_p from lineitem")
def reduce_minmax4(spark, d):
    # as the reduction of one vector: maxima are minima of the negated values
    lo = table(spark, d, "lineitem").agg(F.min("l_quantity").alias("a"), F.min(-F.col("l_quantity")).alias("b"), F.min("l_extendedprice").alias("c"), F.min(-F.col("l_extendedprice")).alias("e"))
    return lo.select(F.col("a").alias("lo_q"), (-F.col("b")).alias("hi_q"), F.col("c").alias("lo_p"), (-F.col("e")).alias("hi_p"))


@register("reduce_mixed_norms", """select count(*)::bigint as n, round(sum(o_totalprice) / count(*), 4) as mean, round(sum(o_totalprice / 1000 * (o_totalprice / 1000)) / count(*), 4) as mean_square, max(o_totalprice) as most from orders""")
def reduce_mixed_norms(spark, d):
    k = F.col("o_totalprice") / 1000
    got = table(spark, d, "orders").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.sum(k * k).alias("q"), F.max("o_totalprice").alias("most"))
    return got.select("n", F.round(F.col("s") / F.col("n"), 4).alias("mean"), F.round(F.col("q") / F.col("n"), 4).alias("mean_square"), "most")


_LONG = "select vec_id, label, (generate_subscripts(embedding, 1) - 1)::bigint as dim, unnest(embedding)::double as x from embeddings"


@register("reduce_vector_sum", f"select label, dim, round(sum(x), 6) as total from ({_LONG}) group by 1, 2")
def reduce_vector_sum(spark, d):
    return vec.long_form(table(spark, d, "embeddings"), "embedding", "label").groupBy("label", "dim").agg(F.round(F.sum("x"), 6).alias("total"))


@register("reduce_struct_merge", f"select label, dim, count(*)::bigint as n, round(sum(x) / count(*), 6) as mean from ({_LONG}) group by 1, 2")
def reduce_struct_merge(spark, d):
    got = vec.long_form(table(spark, d, "embeddings"), "embedding", "label").groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    return got.select("label", "dim", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@register("tree_reduce", "select count(*)::bigint as layers, sum(s) as total, sum(n)::bigint as n from (select l_orderkey % 4 as layer, sum(l_quantity) as s, count(*) as n from lineitem group by 1)")
def tree_reduce(spark, d):
    return comm.tree_reduce(table(spark, d, "lineitem"), "l_orderkey", 4, [F.sum("l_quantity").alias("s"), F.count("*").alias("c")], [F.count("*").alias("layers"), F.sum("s").alias("total"), F.sum("c").alias("n")])


@register("all_reduce", "select o_orderstatus, count(*)::bigint as n, (sum(count(*)) over ())::bigint as everyone from orders group by 1")
def all_reduce(spark, d):
    by = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return comm.all_reduce(by, F.sum("n").alias("everyone"))


@register("all_gather", "select r.range::bigint as part, count(*)::bigint as messages, sum(s.n_nationkey)::bigint as total from range(25) r, nation s group by 1")
def all_gather(spark, d):
    sent = comm.all_gather(table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_nationkey").cast("long").alias("v")), 25, "v")
    return sent.groupBy("part").agg(F.count("*").alias("messages"), F.sum("v").alias("total"))


def event_cells(spark, d):
    """Events on a grid of days and hours: ``x, y, v``."""
    t = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = F.floor(F.col("us") / 3_600_000_000)
    return t.groupBy(F.floor(hour / 24).cast("long").alias("x"), (hour % 24).cast("long").alias("y")).agg(F.sum("value").alias("v"))


EVENT_CELLS = "select (epoch_us(ts) // 3600000000 // 24)::bigint as x, (epoch_us(ts) // 3600000000 % 24)::bigint as y, sum(value) as v from events group by 1, 2"


@register("halo_exchange", f"""with c as ({EVENT_CELLS}) select a.x, a.y, count(b.x)::bigint as ghosts, round(coalesce(sum(b.v), 0), 4) as ghost_sum
from c a left join c b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 and not (a.x = b.x and a.y = b.y) group by 1, 2""")
def halo_exchange(spark, d):
    c = event_cells(spark, d)
    around = grid.with_neighbours(c.select("x", "y"), ["x", "y"], centre=False)
    other = c.select(F.col("x").alias("nx"), F.col("y").alias("ny"), "v")
    return around.join(other, ["nx", "ny"], "left").groupBy("x", "y").agg(F.count("v").alias("ghosts"), F.round(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("ghost_sum"))


@register("upsert_if_unreached", """select c_custkey, case when c_acctbal < 0 and m is not null then m else c_acctbal end as level
from customer left join (select o_custkey, max(o_totalprice) as m from orders group by 1) on o_custkey = c_custkey""")
def upsert_if_unreached(spark, d):
    got = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    nodes = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("level"))
    return comm.upsert_where(nodes, got, "c_custkey", "level", "m", F.col("level") < 0)


@register("gid_lookup", "select p_brand, count(*)::bigint as n, sum(l_quantity) as quantity from lineitem join part on l_partkey = p_partkey group by 1")
def gid_lookup(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("c"), F.sum("l_quantity").alias("q"))
    return lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("c").alias("n"), F.sum("q").alias("quantity"))


@register("boundary_push", "select o_custkey % 16 as part, o_orderstatus as tag, count(*)::bigint as pushed, round(sum(o_totalprice), 2) as added from orders group by 1, 2")
def boundary_push(spark, d):
    sent = comm.scatter(table(spark, d, "orders"), F.col("o_custkey") % 16, tag=F.col("o_orderstatus"), v=F.col("o_totalprice"))
    return sent.groupBy(F.col("dst").alias("part"), "tag").agg(F.count("*").alias("pushed"), F.round(F.sum("v"), 2).alias("added"))


@register("loop_barrier", "select 10::bigint as trips, (25 ** 10)::bigint as value")
def loop_barrier(spark, d):
    parts = table(spark, d, "nation").select("n_nationkey")

    def body(state, _):
        return {"s": comm.broadcast_value(parts, state["s"]).agg(F.sum("value").alias("value"))}

    return loop({"s": spark.range(1).select(F.lit(1).cast("long").alias("value"))}, 10, body)["s"].select(F.lit(10).cast("long").alias("trips"), "value")


@register("sumup_layered", "select 10::bigint as trips, count(*)::double as total from orders")
def sumup_layered(spark, d):
    ones = table(spark, d, "orders").select(F.col("o_orderkey").alias("part"), F.lit(1.0).alias("v"))

    def body(state, _):  # each trip sums the same values by layers again and sends the sum back with the trip's number, which goes on
        total = comm.tree_reduce(ones, "part", 4, [F.sum("v").alias("s")], [F.sum("s").alias("now")])
        return {"t": comm.broadcast_value(state["t"], total).select((F.col("trips") + 1).alias("trips"), F.col("now").alias("total"))}

    return loop({"t": spark.range(1).select(F.lit(0).cast("long").alias("trips"), F.lit(0.0).alias("total"))}, 10, body, cut_every=1)["t"]


@register("scatter_self_counts", "select l_linenumber::bigint as src, (l_orderkey % 4)::bigint as dst, count(*)::bigint as n from lineitem group by 1, 2")
def scatter_self_counts(spark, d):
    sent = comm.ordered_scatter(table(spark, d, "lineitem"), F.col("l_orderkey") % 4, F.col("l_linenumber").cast("long"))
    return sent.groupBy("src", "dst").agg(F.count("*").alias("n"))


@register("track_progress", """select stage, stmt, us - first_value(us) over (partition by stmt order by stage) as since from
(select event_type as stmt, row_number() over (partition by event_type order by ts, event_id)::bigint as stage, epoch_us(ts)::bigint as us from events)""")
def track_progress(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.row_number().over(w).cast("long").alias("stage"), F.col("event_type").alias("stmt"), (us - F.first(us).over(w)).alias("since"))
