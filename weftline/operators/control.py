"""Decisions about placement, balance and progress, as queries over tables of workers, partitions and samples.

The tables are the size of a cluster (workers, partitions), not of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpoint


def place_round_robin(parts: DataFrame, workers: DataFrame) -> DataFrame:
    """Partition i of each group (grp, part) goes to the i-th worker by id, cyclically: ``grp, part, worker``."""
    numbered = workers.select("worker", (F.row_number().over(Window.orderBy("worker")) - 1).alias("slot"))
    n = workers.agg(F.count("*").alias("n"))
    i = F.row_number().over(Window.partitionBy("grp").orderBy("part")) - 1
    return parts.withColumn("i", i).join(F.broadcast(n), F.lit(True)).withColumn("slot", (F.col("i") % F.col("n")).cast("int")).join(F.broadcast(numbered), "slot").select("grp", "part", "worker")


def place_by_cores(parts: DataFrame, workers: DataFrame, seed: int | None = None) -> DataFrame:
    """Slots in proportion to cores, dealt on across groups; with a seed the order of partitions is shuffled."""
    slots = workers.where("cores > 0").select("worker", F.explode(F.sequence(F.lit(1), F.col("cores"))).alias("core"))
    slots = slots.select("worker", (F.row_number().over(Window.orderBy("worker", "core")) - 1).alias("slot"))
    n = slots.agg(F.count("*").alias("n"))
    order = [F.xxhash64(F.lit(seed), "grp", "part")] if seed is not None else []
    i = F.row_number().over(Window.orderBy(*order, "grp", "part")) - 1
    return parts.withColumn("i", i).join(F.broadcast(n), F.lit(True)).withColumn("slot", (F.col("i") % F.col("n")).cast("int")).join(F.broadcast(slots), "slot").select("grp", "part", "worker")


def invalid_placements(decisions: DataFrame, parts: DataFrame, workers: DataFrame) -> DataFrame:
    """What is wrong with decisions (grp, part, worker): ``grp, part, reason``; no rows if all is well."""
    running = workers.where("state = 'RUNNING'").select("worker")
    unknown = decisions.join(parts, ["grp", "part"], "left_anti").select("grp", "part", F.lit("no such partition").alias("reason"))
    dead = decisions.join(running, "worker", "left_anti").select("grp", "part", F.lit("no such running worker").alias("reason"))
    lost = parts.join(decisions, ["grp", "part"], "left_anti").select("grp", "part", F.lit("not placed").alias("reason"))
    return unknown.unionByName(dead).unionByName(lost)


def expected_load(workers: DataFrame, partitions: int) -> DataFrame:
    """``worker, expected``: cores times the share per core, and the rest dealt one by one to the first live workers."""
    live = workers.where("cores > 0")
    total = live.agg(F.sum("cores").alias("total"))
    w = live.join(F.broadcast(total), F.lit(True))
    per = F.floor(F.lit(partitions) / F.col("total"))
    rest = F.lit(partitions) - per * F.col("total")
    i = F.row_number().over(Window.orderBy("worker")) - 1
    n = F.count("*").over(Window.partitionBy())
    extra = F.floor(rest / n) + F.when(i < rest % n, 1).otherwise(0)
    return w.select("worker", (F.col("cores") * per + extra).cast("long").alias("expected"))


def moves(owned: DataFrame, expected: DataFrame) -> DataFrame:
    """Migrations that bring every worker to its expected load: ``part, src, dst``.

    Over-full workers give their lowest partitions; the k-th given goes to the k-th free place.
    """
    ranked = owned.withColumn("i", F.row_number().over(Window.partitionBy("worker").orderBy("part")))
    have = owned.groupBy("worker").agg(F.count("*").alias("have"))
    load = have.join(expected, "worker", "full").select("worker", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("expected", F.lit(0)).alias("expected"))
    over = ranked.join(load, "worker").where(F.col("i") <= F.col("have") - F.col("expected")).withColumn("k", F.row_number().over(Window.orderBy("worker", "part")))
    free = load.where("expected > have").select("worker", F.explode(F.sequence(F.lit(1), (F.col("expected") - F.col("have")).cast("int"))).alias("j")).withColumn("k", F.row_number().over(Window.orderBy("worker", "j")))
    return over.join(free.select(F.col("worker").alias("dst"), "k"), "k").select("part", F.col("worker").alias("src"), "dst")


def straggler(workers: DataFrame) -> DataFrame:
    """The worker with the most CPU that isn't its own (all_pct - own_pct), ties to the least id: one row ``worker, others``."""
    return workers.agg(F.min(F.struct((F.col("own_pct") - F.col("all_pct")).alias("o"), "worker")).alias("m")).select("m.worker", (-F.col("m.o")).alias("others"))


def without_straggler(workers: DataFrame) -> DataFrame:
    """``workers`` with no cores at the straggler, for expected_load()."""
    s = straggler(workers).select(F.col("worker").alias("slow"))
    return workers.join(F.broadcast(s), F.lit(True)).withColumn("cores", F.when(F.col("worker") == F.col("slow"), 0).otherwise(F.col("cores"))).drop("slow")


def swap_first(owned: DataFrame) -> DataFrame:
    """The first partitions of the two first workers change places: ``part, src, dst``."""
    firsts = owned.groupBy("worker").agg(F.min("part").alias("part")).orderBy("worker").limit(2)
    pair = firsts.agg(F.array_sort(F.collect_list(F.struct("worker", "part"))).alias("p")).where(F.size("p") == 2)
    a, b = F.col("p")[0], F.col("p")[1]
    each = F.array(F.struct(a["part"].alias("part"), a["worker"].alias("src"), b["worker"].alias("dst")), F.struct(b["part"].alias("part"), b["worker"].alias("src"), a["worker"].alias("dst")))
    return pair.select(F.explode(each).alias("m")).select("m.*")


def merge_map(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest version of each entry: keys, ``worker``, ``version``."""
    return updates.groupBy(*keys).agg(F.max(F.struct("version", "worker")).alias("m")).select(*keys, "m.worker", "m.version")


def look_up(asked: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """``asked`` with the worker of each entry, -1 where there is none."""
    return asked.join(current.select(*keys, "worker"), list(keys), "left").withColumn("worker", F.coalesce("worker", F.lit(-1)))


def route(version: Column, own_version: Column, dst: Column, here: Column, known: Column) -> Column:
    """What becomes of a message: deliver if its map is as new as the worker's own or it is for this worker, else forward, or pend where the owner isn't known."""
    return F.when((version >= own_version) | (dst == here), "deliver").when(known, "forward").otherwise("pend")


def receivers(current: DataFrame) -> DataFrame:
    """Partitions by worker, for one copy of a message a worker: ``worker, parts`` (sorted)."""
    return current.groupBy("worker").agg(F.array_sort(F.collect_list("part")).alias("parts"))


def roll_up(stats: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``last`` stage, sum of ``cycles``, and partitions heard from; with ``total`` only if that many were."""
    out = stats.groupBy(key).agg(F.max("stage").alias("last"), F.sum("cycles").alias("cycles"), F.countDistinct("part").alias("parts"))
    return out if total is None else out.where(F.col("parts") == total)


def islands(stats: DataFrame, part: str = "part") -> DataFrame:
    """Stages of one loop trip as one record: they move on as their statements do, so stage - stmt is constant."""
    return stats.groupBy(part, (F.col("stage") - F.col("stmt")).alias("trip")).agg(F.min("stage").alias("first"), F.max("stage").alias("last"), F.sum("cycles").alias("cycles"))


def cpu_percent(samples: DataFrame) -> DataFrame:
    """Percent of the machine that the process took since its last sample; none for the first."""
    w = Window.partitionBy("worker").orderBy("sample")
    delta = lambda c: F.col(c) - F.lag(c).over(w)
    return samples.select("worker", "sample", (100.0 * delta("proc") / F.nullif(delta("busy") + delta("idle"), F.lit(0))).alias("pct"))


def dependencies(accesses: DataFrame, *scope: str) -> DataFrame:
    """For each access (stmt, var, mode READ or WRITE): the last write before it, and the reads since.

    A read waits for ``last_write``; a write waits for that and for ``reads_since`` reads.
    """
    w = Window.partitionBy(*scope, "var").orderBy("stmt").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("mode") == "WRITE", F.col("stmt"))).over(w)
    a = accesses.withColumn("last_write", last)
    since = Window.partitionBy(*scope, "var", "last_write").orderBy("stmt").rowsBetween(Window.unboundedPreceding, -1)
    reads = F.when(F.col("mode") == "WRITE", F.coalesce(F.sum(F.when(F.col("mode") == "READ", 1).otherwise(0)).over(since), F.lit(0)))
    return a.select(*scope, "stmt", "var", "mode", "last_write", reads.alias("reads_since"))


def ready_order(queue: DataFrame, *scope: str) -> DataFrame:
    """Order of service: reports first, then the lowest priority value, first come first."""
    w = Window.partitionBy(*scope).orderBy(F.col("report").desc(), "priority", "seq")
    return queue.withColumn("turn", F.row_number().over(w))


#: Rows of a block of in_order().
BLOCK_ROWS = 200_000


def in_order(rows: DataFrame, seq: str) -> DataFrame:
    """``rows`` with ``__block``: blocks of some BLOCK_ROWS rows that follow each other in the order of ``seq``; equal ones share a block.

    Written once, so that blocks stay as they are however often they are read. Running values over all rows are then
    those within a block (a window by ``__block``) on top of what the blocks before come to (a row a block).
    """
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return checkpoint(rows.repartitionByRange(n, seq).withColumn("__block", F.spark_partition_id()))


def running_sums(blocks: DataFrame, seq: str, *columns: str) -> DataFrame:
    """Rows of in_order() with ``columns`` replaced by their sums up to each row and its equals; null before the first value."""
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("__block").agg(*(F.sum(c).alias(c) for c in columns))
    sums = sums.select("__block", *(F.sum(c).over(before).alias(f"__before_{c}") for c in columns))
    w = Window.partitionBy("__block").orderBy(seq)
    within = blocks.withColumns({c: F.sum(c).over(w) for c in columns}).join(F.broadcast(sums), "__block")
    return within.withColumns({c: F.coalesce(F.col(f"__before_{c}") + F.col(c), c, f"__before_{c}") for c in columns}).drop(*(f"__before_{c}" for c in columns))


def fair_share(samples: DataFrame, share: float, threshold: float) -> DataFrame:
    """Which of two applications runs first: the ratio of used cycles against share (1 +- threshold).

    samples: seq, a, b (cycles so far), of in_order() or else put in order here. ``first``: a if a is behind its share, b if
    it's ahead, else as before (null until either happened).
    """
    if "__block" not in samples.columns:
        samples = in_order(samples, "seq")
    ratio = F.col("a") / F.nullif(F.col("b"), F.lit(0))
    now = F.when(ratio < share * (1 - threshold), "a").when(ratio > share * (1 + threshold), "b")
    s = samples.select("__block", "seq", ratio.alias("ratio"), now.alias("now"))
    ends = s.groupBy("__block").agg(F.max(F.when(F.col("now").isNotNull(), F.struct("seq", "now")))["now"].alias("now"))
    before = ends.select("__block", F.last("now", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    within = F.last("now", ignorenulls=True).over(Window.partitionBy("__block").orderBy("seq"))
    return s.withColumn("first", within).join(F.broadcast(before), "__block").select("seq", "ratio", F.coalesce("first", "__before").alias("first"))


def loop_pairs(statements: DataFrame, *scope: str) -> DataFrame:
    """Matches of nested begins and ends (stmt, kind BEGIN or END): ``start, stop``, by depth."""
    order = Window.partitionBy(*scope).orderBy("stmt")
    depth = F.sum(F.when(F.col("kind") == "BEGIN", 1).otherwise(-1)).over(order) + F.when(F.col("kind") == "END", 1).otherwise(0)
    s = statements.withColumn("depth", depth)
    nth = F.row_number().over(Window.partitionBy(*scope, "depth", "kind").orderBy("stmt"))
    s = s.withColumn("nth", nth)
    a, b = s.where("kind = 'BEGIN'"), s.where("kind = 'END'")
    return a.select(*scope, "depth", "nth", F.col("stmt").alias("start")).join(b.select(*scope, "depth", "nth", F.col("stmt").alias("stop")), [*scope, "depth", "nth"]).select(*scope, "start", "stop")


def variable_groups(accesses: DataFrame, rounds: int = 50) -> DataFrame:
    """Variables ever used in one statement share a group: ``var, grp`` (the least variable reachable).

    Least labels pass between statements and variables until nothing changes.
    """
    edges = accesses.select("stmt", "var").distinct().persist()
    labels = edges.select("var").distinct().withColumn("grp", F.col("var"))
    for _ in range(rounds):
        by_stmt = edges.join(labels, "var").groupBy("stmt").agg(F.min("grp").alias("grp"))
        least = edges.join(by_stmt, "stmt").groupBy("var").agg(F.min("grp").alias("grp"))
        new = checkpoint(least.join(least.select(F.col("var").alias("grp"), F.col("grp").alias("g2")), "grp").select("var", F.least("grp", "g2").alias("grp")))
        if new.join(labels, ["var", "grp"], "left_anti").isEmpty():
            return new
        labels = new
    raise RuntimeError(f"groups didn't settle in {rounds} rounds")
