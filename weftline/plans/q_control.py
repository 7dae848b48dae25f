"""Queries for placement, balance, progress and run logs. Nations stand for workers, suppliers per nation for cores, events for stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import control
from weftline.plans.catalogue import register
from weftline.session import table
from weftline.sources import runlog

_W = "w as (select n_nationkey::bigint as worker, (select count(*) from supplier where s_nationkey = n_nationkey)::bigint as cores, n_regionkey from nation)"
_PARTS = "p as (select (c_custkey % 3)::bigint as grp, c_custkey as part from customer)"


def workers(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("c"))
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select(F.col("n_nationkey").cast("long").alias("worker"), F.coalesce("c", F.lit(0)).cast("int").alias("cores"), "n_regionkey")


def parts(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") % 3).alias("grp"), F.col("c_custkey").alias("part"))


@register("place_round_robin", f"with {_W}, {_PARTS}, o as (select worker, row_number() over (order by worker) - 1 as slot from w) select grp, part, worker from (select *, row_number() over (partition by grp order by part) - 1 as i from p) join o on i % 25 = slot")
def place_round_robin(spark, d):
    return control.place_round_robin(parts(spark, d), workers(spark, d).select("worker"))


_SLOTS = "o as (select worker, row_number() over (order by worker, c) - 1 as slot from w, lateral (select unnest(range(cores)) as c))"


@register("place_core_weighted", f"with {_W}, {_PARTS}, {_SLOTS} select grp, part, worker from (select *, row_number() over (order by grp, part) - 1 as i from p) join o on i % (select count(*) from o) = slot")
def place_core_weighted(spark, d):
    return control.place_by_cores(parts(spark, d), workers(spark, d))


@register("placement_check", "select (c_custkey % 3)::bigint as grp, c_custkey as part, case when c_nationkey % 5 = 4 then 'no such running worker' else 'not placed' end as reason from customer where c_nationkey % 5 = 4 or c_acctbal < 0 and c_nationkey % 5 <> 4")
def placement_check(spark, d):
    c = table(spark, d, "customer")
    placed = c.where("c_acctbal >= 0 or c_nationkey % 5 = 4").select((F.col("c_custkey") % 3).alias("grp"), F.col("c_custkey").alias("part"), F.col("c_nationkey").cast("long").alias("worker"))
    state = workers(spark, d).withColumn("state", F.when(F.col("worker") % 5 == 4, "KILLED").otherwise("RUNNING"))
    return control.invalid_placements(placed, parts(spark, d), state)


def _expected_sql(cores="cores"):
    return f"""x as (select worker, {cores} as cores from w where {cores} > 0), t as (select sum(cores) as total, count(*) as n, (select count(*) from customer) as p from x),
ex as (select worker, (cores * (p // total) + (p - p // total * total) // n + case when row_number() over (order by worker) - 1 < (p - p // total * total) % n then 1 else 0 end)::bigint as expected from x, t)"""


@register("balance_expected", f"with {_W}, {_expected_sql()} select worker, expected from ex")
def balance_expected(spark, d):
    return control.expected_load(workers(spark, d), table(spark, d, "customer").count())


@register("balance_moves", f"""with {_W}, {_expected_sql()}, own as (select c_custkey as part, c_nationkey::bigint as worker from customer),
l as (select worker, coalesce(have, 0) as have, coalesce(expected, 0) as expected from (select worker, count(*) as have from own group by 1) full join ex using (worker)),
o as (select part, worker, row_number() over (order by worker, part) as k from (select *, row_number() over (partition by worker order by part) as i from own) join l using (worker) where i <= have - expected),
f as (select worker as dst, row_number() over (order by worker, j) as k from l, lateral (select unnest(range(expected - have)) as j) where expected > have)
select part, worker as src, dst from o join f using (k)""")
def balance_moves(spark, d):
    c = table(spark, d, "customer")
    return control.moves(c.select(F.col("c_custkey").alias("part"), F.col("c_nationkey").cast("long").alias("worker")), control.expected_load(workers(spark, d), c.count()))


def _loads(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("worker")).agg(F.round(F.sum("s_acctbal"), 2).alias("all_pct"), F.round(F.min("s_acctbal"), 2).alias("own_pct"), F.count("*").cast("int").alias("cores"))
    return s


_LOADS = "q as (select s_nationkey::bigint as worker, round(sum(s_acctbal), 2) - round(min(s_acctbal), 2) as others from supplier group by 1)"


@register("straggler_pick", f"with {_LOADS} select worker, round(others, 2) as others from q order by others desc, worker limit 1")
def straggler_pick(spark, d):
    return control.straggler(_loads(spark, d)).select("worker", F.round("others", 2).alias("others"))


@register("straggler_rebalance", f"with {_LOADS}, w as (select worker, cores, s.slow from (select s_nationkey::bigint as worker, count(*)::bigint as cores from supplier group by 1), (select worker as slow from q order by others desc, worker limit 1) s), {_expected_sql('(case when worker = slow then 0 else cores end)')} select worker, expected from ex")
def straggler_rebalance(spark, d):
    return control.expected_load(control.without_straggler(_loads(spark, d)), table(spark, d, "customer").count())


@register("swap_first", "with f as (select c_nationkey::bigint as worker, min(c_custkey) as part from customer group by 1 order by 1 limit 2) select a.part, a.worker as src, b.worker as dst from f a join f b on a.worker <> b.worker")
def swap_first(spark, d):
    return control.swap_first(table(spark, d, "customer").select(F.col("c_custkey").alias("part"), F.col("c_nationkey").cast("long").alias("worker")))


@register("partition_map_merge", "select c_custkey as part, coalesce(worker, -1)::bigint as worker from customer left join (select o_custkey, arg_max(o_orderkey % 25, o_orderkey) as worker from orders group by 1) on o_custkey = c_custkey")
def partition_map_merge(spark, d):
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("part"), (F.col("o_orderkey") % 25).alias("worker"), F.col("o_orderkey").alias("version"))
    return control.look_up(table(spark, d, "customer").select(F.col("c_custkey").alias("part")), control.merge_map(updates, "part"), "part")


@register("route_decision", "select o_orderkey, case when o_orderkey % 10 >= 5 or o_custkey % 25 = 7 then 'deliver' when o_custkey % 25 < 20 then 'forward' else 'pend' end as decision from orders")
def route_decision(spark, d):
    dst = F.col("o_custkey") % 25
    return table(spark, d, "orders").select("o_orderkey", control.route(F.col("o_orderkey") % 10, F.lit(5), dst, F.lit(7), dst < 20).alias("decision"))


@register("multicast_receivers", "select c_nationkey::bigint as worker, string_agg(c_custkey::varchar, ',' order by c_custkey) as parts from customer group by 1")
def multicast_receivers(spark, d):
    got = control.receivers(table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("worker"), F.col("c_custkey").alias("part")))
    return got.select("worker", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


_STAGES = "st as (select event_type as stmt, user_id as part, value as v, epoch_us(ts)::bigint as us, row_number() over (partition by event_type order by ts, event_id)::bigint as stage from events)"


def stages(spark, d):
    t = table(spark, d, "events")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return t.select(F.col("event_type").alias("stmt"), F.col("user_id").alias("part"), F.col("value").alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.row_number().over(w).cast("long").alias("stage"))


@register("stats_rollup", f"with {_STAGES} select stmt, max(stage)::bigint as last, round(sum(v), 4) as cycles, count(distinct part)::bigint as parts from st group by 1")
def stats_rollup(spark, d):
    got = control.roll_up(stages(spark, d).withColumn("cycles", F.col("v")), "stmt")
    return got.select("stmt", "last", F.round("cycles", 4).alias("cycles"), "parts")


@register("cycle_islands", "select l_orderkey % 100 as part, (l_linenumber - l_linenumber % 3)::bigint as trip, min(l_linenumber)::bigint as first, max(l_linenumber)::bigint as last, sum(l_quantity) as cycles from lineitem group by 1, 2")
def cycle_islands(spark, d):
    s = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("part"), F.col("l_linenumber").cast("long").alias("stage"), (F.col("l_linenumber") % 3).cast("long").alias("stmt"), F.col("l_quantity").alias("cycles"))
    return control.islands(s)


@register("cpu_delta_pct", """select worker, sample, round(100.0::double * (proc - lag(proc) over w) / ((busy - lag(busy) over w) + (idle - lag(idle) over w)), 6) as pct
from (select user_id as worker, event_id as sample, event_id * 3 as proc, event_id * 5 as busy, event_id * 2 + user_id as idle from events) window w as (partition by worker order by sample)""")
def cpu_delta_pct(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    got = control.cpu_percent(table(spark, d, "events").select(u.alias("worker"), e.alias("sample"), (e * 3).alias("proc"), (e * 5).alias("busy"), (e * 2 + u).alias("idle")))
    return got.withColumn("pct", F.round("pct", 6))


_ACC = "a as (select event_id as stmt, user_id as var, case when event_id % 4 = 0 then 'WRITE' else 'READ' end as mode from events)"


@register("stage_dependencies", f"""with {_ACC}, b as (select *, max(case when mode = 'WRITE' then stmt end) over (partition by var order by stmt rows between unbounded preceding and 1 preceding) as last_write from a)
select stmt, var, mode, last_write, (case when mode = 'WRITE' then coalesce(sum(case when mode = 'READ' then 1 else 0 end) over (partition by var, last_write order by stmt rows between unbounded preceding and 1 preceding), 0) end)::bigint as reads_since from b""")
def stage_dependencies(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("stmt"), F.col("user_id").alias("var"), F.when(F.col("event_id") % 4 == 0, "WRITE").otherwise("READ").alias("mode"))
    return control.dependencies(a)


@register("variable_groups", """with recursive e as (select s_suppkey as stmt, s_nationkey::bigint as var from supplier union all select s_suppkey, 1000 + s_suppkey from supplier),
r(var, reach) as (select distinct var, var from e union select r.var, b.var from r join e a on a.var = r.reach join e b on a.stmt = b.stmt) select var, min(reach)::bigint as grp from r group by 1""")
def variable_groups(spark, d):
    both = F.explode(F.array(F.col("s_nationkey").cast("long"), 1000 + F.col("s_suppkey"))).alias("var")
    return control.variable_groups(table(spark, d, "supplier").select(F.col("s_suppkey").alias("stmt"), both))


@register("fair_share_flip", """with s as (select event_id as seq, sum(case when user_id % 2 = 0 then value else 0 end) over o as a, sum(case when user_id % 2 = 1 then value else 0 end) over o as b from events window o as (order by event_id)),
n as (select seq, round(a / nullif(b, 0), 4) as ratio, case when round(a / nullif(b, 0), 4) < 0.9 then 'a' when round(a / nullif(b, 0), 4) > 1.1 then 'b' end as now from s)
select seq, ratio, last_value(now ignore nulls) over (order by seq rows between unbounded preceding and current row) as first from n""")
def fair_share_flip(spark, d):
    own = lambda k: F.when(F.col("user_id") % 2 == k, F.col("value")).otherwise(0.0)
    e = control.in_order(table(spark, d, "events").select(F.col("event_id").alias("seq"), own(0).alias("a"), own(1).alias("b")), "seq")
    s = control.running_sums(e, "seq", "a", "b")
    s = s.select("__block", "seq", F.round(F.col("a") / F.nullif("b", F.lit(0)), 4).alias("a"), F.lit(1.0).alias("b"))
    return control.fair_share(s, 1.0, 0.1)


@register("loop_pairs", """select s.o as app, s.start, s.stop from (select o_orderkey as o, 1::bigint as start, 6::bigint as stop from orders union all select o_orderkey, 2, 3 from orders union all select o_orderkey, 4, 5 from orders) s""")
def loop_pairs(spark, d):
    six = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("stmt"), F.lit(k).alias("kind")) for i, k in enumerate(["BEGIN", "BEGIN", "END", "BEGIN", "END", "END"], 1))))
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("app"), six.alias("s")).select("app", "s.*")
    return control.loop_pairs(s, "app")


@register("ready_queue", "select o_orderkey, row_number() over (partition by o_custkey order by (o_orderstatus = 'F') desc, o_orderpriority, o_orderkey)::bigint as turn from orders")
def ready_queue(spark, d):
    q = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("report"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("seq"))
    return control.ready_order(q, "o_custkey").select("o_orderkey", F.col("turn").cast("long").alias("turn"))


@register("runlog_intervals", f"""with {_STAGES}, i as (select *, count(*) over (partition by stmt) as n from st), g as (select stmt, us / 1000.0::double - lag(us / 1000.0::double) over (partition by stmt order by stage) as gap from i where stage > 1 and stage < n),
a as (select stmt, list_sort(list(gap)) as g, avg(gap) as mean from g where gap is not null group by 1)
select stmt, len(g)::bigint as gaps, round(g[1], 3) as least, round(g[len(g)], 3) as most, round(g[3], 3) as third_least, round(g[len(g) - 2], 3) as third_most, round(mean, 3) as mean, round(g[len(g) // 2 + 1], 3) as median from a""")
def runlog_intervals(spark, d):
    got = runlog.intervals(stages(spark, d).select("stmt", "stage", (F.col("us") / 1000.0).alias("value")))
    return got.select("stmt", "gaps", *(F.round(c, 3).alias(c) for c in ("least", "most", "third_least", "third_most", "mean", "median")))


@register("runlog_cycles", f"with {_STAGES}, s as (select stmt, stage // 100 as stage, sum(v) as c from st group by 1, 2), m as (select stmt, min(stage) as lo, max(stage) as hi from s group by 1) select stmt, count(*)::bigint as stages, round(avg(c), 4) as mean from s join m using (stmt) where stage > lo and stage < hi group by 1")
def runlog_cycles(spark, d):
    got = runlog.mean_cycles(stages(spark, d).select("stmt", F.floor(F.col("stage") / 100).alias("stage"), F.col("v").alias("value")))
    return got.withColumn("mean", F.round("mean", 4))


@register("runlog_cycle_sums", f"with {_STAGES} select stmt, stage // 100 as stage, round(sum(v), 4) as cycles from st group by 1, 2")
def runlog_cycle_sums(spark, d):
    return runlog.cycle_sums(stages(spark, d).select("stmt", F.floor(F.col("stage") / 100).alias("stage"), F.col("v").alias("value"))).withColumn("cycles", F.round("cycles", 4))


@register("runlog_partitions", "select (select max(n) from (select count(distinct c_custkey) as n from customer group by c_mktsegment))::bigint as parts, (select count(distinct c_nationkey) from customer)::bigint as workers")
def runlog_partitions(spark, d):
    return runlog.partition_counts(table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_custkey").alias("part"), F.col("c_nationkey").alias("worker")))
