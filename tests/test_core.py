"""Closed forms, invariants, programs, the manager, sources and streams."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import vec
from weftline.operators import clustering, comm, control, levelset, particles, ranking, regression, spatial, stencil
from weftline.operators.iterate import loop, while_loop
from weftline.plans import applications  # noqa: F401
from weftline.plans.manager import Manager
from weftline.plans.program import Program, ProgramError, load
from weftline.sources import fluid, runlog
from weftline.streaming import gather


def test_mesh_ranks(spark):
    got = {r.v: r.rank for r in ranking.walk(ranking.mesh_edges(spark, 4, 4), 10).collect()}
    assert math.isclose(sum(got.values()), 16.0)
    assert math.isclose(got[0], 0.746824467303915) and math.isclose(got[1], 1.0270512595470636) and math.isclose(got[5], 1.1990730136019572)


def test_stencil_goldens(spark):
    g = stencil.smooth(stencil.cube(spark, 10, 10, 10), ["ix", "iy", "iz"], 10)
    rows = {(r.ix, r.iy, r.iz): r.v for r in g.collect()}
    assert math.isclose(sum(rows.values()), 13500.0) and math.isclose(rows[0, 0, 0], 5.66935790680727) and math.isclose(rows[9, 9, 9], 21.33064209319273)


def test_empty_cluster_keeps_its_centre(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 3.0])], "id long, v array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [99.0, 99.0])], "c long, m array<double>")
    assert {r.c: r.m for r in clustering.kmeans(p, c, 2).collect()} == {0: [1.0, 1.0], 1: [99.0, 99.0]}


def test_regression_finds_the_direction(spark):
    r = np.random.default_rng(0)
    x, ref = r.uniform(-1, 1, (400, 3)), np.array([1.0, -2.0, 0.5])
    s = spark.createDataFrame([(a.tolist(), bool(a @ ref > 0)) for a in x], "x array<double>, y boolean")
    w, trips = regression.fit_while(s, [1.0] * 3, 0.1, 1e-4)
    assert trips > 1 and np.dot(w, ref) / np.linalg.norm(w) / np.linalg.norm(ref) > 0.98
    z = x @ np.ones(3)
    want = ((1 / (1 + np.exp(-z)) - (x @ ref > 0))[:, None] * x).sum(axis=0)
    assert np.allclose(regression.gradient(s, [1.0] * 3), want)
    pm = s.withColumn("y", F.when(F.col("y"), 1.0).otherwise(-1.0))
    assert np.allclose(regression.gradient(pm, [1.0] * 3, True), want)


def test_lattice_forces_cancel(spark):
    f = particles.Fluid(4.0)
    n = 4
    rows = [(i, *(f.h / 2 * np.array([i % n, i // n % n, i // n // n])).tolist(), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(n**3)]
    p = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "vx", "vy", "vz", "hx", "hy", "hz")))
    a = particles.forces(particles.density(p, f), f).agg(*(F.sum(f"a{c}").alias(c) for c in "xyz")).first()
    assert abs(a.x) < 1e-6 and abs(a.z) < 1e-6 and math.isclose(a.y, -9.8 * n**3, rel_tol=1e-9)
    assert particles.frame(p, f, -1.0, 10.0).count() == n**3


def test_gather_audits(spark):
    m = spark.createDataFrame([(0, 5), (0, 6), (2, 7)], "dst long, v long")
    assert sorted(map(tuple, comm.missing(m, 3, 2).collect())) == [(0, 2, 0), (1, 0, 2), (2, 1, 1)]
    with pytest.raises(Exception, match="more than one message"):
        comm.gather_single(m, "v").collect()
    ordered = m.withColumn("src", -F.col("v"))
    assert {r.dst: r.inbox for r in comm.ordered_gather(ordered, "v").collect()} == {0: [6, 5], 2: [7]}


def test_results_dont_depend_on_partitions(spark):
    p = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") * 3 % 11).alias("v"))
    one = sorted(map(tuple, comm.tree_reduce(p.repartition(1), "k", 3, [F.sum("v").alias("s")], [F.sum("s")]).collect()))
    assert one == sorted(map(tuple, comm.tree_reduce(p.repartition(13), "k", 3, [F.sum("v").alias("s")], [F.sum("s")]).collect()))


def test_loops(spark):
    s = {"x": spark.range(1).select(F.lit(1).alias("v"))}
    double = lambda st, _: {"x": st["x"].withColumn("v", F.col("v") * 2)}
    assert loop(s, 10, double)["x"].first().v == 1024 and loop(s, -1, double)["x"].first().v == 1
    out, trips = while_loop(s, lambda r: r.v < 100, "x", double)
    assert (out["x"].first().v, trips) == (128, 7)
    with pytest.raises(RuntimeError):
        while_loop(s, lambda r: True, "x", double, most=2)
    with pytest.raises(ValueError):
        while_loop({"x": spark.range(2)}, lambda r: True, "x", double)


def test_programs(spark):
    assert load("sumup", {"partitions": "4", "doubles": 102, "iterations": 2}).run(spark)["total"].first().s == 100.0
    assert load("barrier", {"iterations": 5, "partitions": 3}).run(spark)["one"].first().v == 243
    assert load("halving").run(spark)["x"].first().v == 0.0625
    assert "LOOP 10" in load("sumup").explain() and "group" in load("sumup").explain()


def test_program_errors():
    p = Program()
    a, b = p.declare("a", "v long", 2), p.declare("b", "v long", 3)
    with pytest.raises(ProgramError, match="partitions"):
        p.reading(a).writing(b).transform(dict).validate()
    q = Program()
    q.declare("a", "v long")
    with pytest.raises(ProgramError, match="inferred"):
        q.validate()
    r = Program()
    r.loop(3)
    with pytest.raises(ProgramError, match="Loops unpaired!"):
        r.validate()
    s = Program()
    x = s.declare("x", "v long", 1)
    with pytest.raises(ProgramError, match="followed by a gather"):
        s.reading(x).scatter(dict).validate()
    t = Program()
    y = t.declare("y", "v long", 2)
    with pytest.raises(ProgramError, match="one partition"):
        t.reading(y).while_(bool).end_while().validate()
    with pytest.raises(ProgramError, match="no application"):
        load("nothing")


def test_manager(spark):
    m = Manager(spark)
    assert not m.launch("nothing").succeed and not m.launch("barrier", priority=-1).succeed and not m.pause(99).succeed
    got = m.launch("barrier", {"iterations": 6}, first_barrier=2)
    for _ in range(300):
        if m.report(got.application_id).value["state"] == "AT_BARRIER":
            break
        time.sleep(0.1)
    assert m.report(got.application_id).value["state"] == "AT_BARRIER" and not m.pause(got.application_id).succeed
    assert m.prioritise(got.application_id, 1).succeed and m.resume(got.application_id).succeed
    assert m.result(got.application_id)["one"].first().v == 64 and not m.resume(got.application_id).succeed


def test_cluster_of_three(spark):
    w = spark.createDataFrame([(0, 1), (1, 2), (2, 4)], "worker long, cores int")
    e = control.expected_load(w, 17)
    assert sorted(map(tuple, e.collect())) == [(0, 3), (1, 5), (2, 9)]
    owned = spark.range(17).select(F.col("id").alias("part"), F.lit(0).cast("long").alias("worker"))
    moved = control.moves(owned, e).collect()
    assert len(moved) == 14 and sorted(r.part for r in moved) == list(range(14)) and sum(r.dst == 2 for r in moved) == 9


def test_run_log(spark, tmp_path):
    lines = ["L 9 old x 0", "B", "L 1 app p 0", "P 1 app 0 part 0"] + ["P 1 0 0 W 3", "P 1 0 1 W 4", "P 1 1 0 W 3"]
    lines = ["B", "L 1 app p 0", "P 1 0 0 W 3", "P 1 0 1 W 4"] + [f"T {i} 2 {v}" for i, v in enumerate([0, 5, 9, 20, 21, 40, 41, 99])] + [f"C {i} 2 {i}" for i in range(4)] + ["M 1 2 3"]
    (tmp_path / "log").write_text("\n".join(lines))
    log = runlog.last_session(runlog.read(spark, str(tmp_path / "log")))
    assert {r.app for r in log.where("kind = 'T'").collect()} == {1}
    r = runlog.intervals(log.where("kind = 'T'").select("stmt", "stage", "value")).first()
    assert (r.gaps, r.least, r.most, r.third_least, r.third_most, r.mean, r["median"]) == (5, 1.0, 19.0, 4.0, 4.0, 7.2, 4.0)
    assert runlog.mean_cycles(log.where("kind = 'C'")).first().mean == 1.5
    assert tuple(runlog.partition_counts(log.where("kind = 'P'")).first()) == (2, 2)


def test_front_is_around_the_middle(spark):
    nodes, zn = levelset.mesh_nodes(spark, 6), levelset.mesh_zone_nodes(spark, 6)
    d = F.sqrt(sum(((F.col(a) - 0.5) * (F.col(a) - 0.5) for a in "xyz"), F.lit(0.0)))
    out = levelset.front(nodes.select("gid", (d - 0.3).alias("level")), nodes, zn, 1 / 6).collect()
    r = [math.dist((v.x, v.y, v.z), (0.5, 0.5, 0.5)) for f in out for v in f.vertices]
    assert len(out) > 20 and all(0.25 < x < 0.32 for x in r) and all(3 <= len(f.vertices) <= 6 for f in out)


def test_triangle_point(spark):
    r = np.random.default_rng(1)
    a, b, c = (np.array(v) for v in ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.2, 0.9, 0.3)))
    pts = r.uniform(-1, 2, (60, 3))
    df = spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(pts)], "id long, x double, y double, z double")
    lit = lambda v: vec.p3(*(F.lit(float(q)) for q in v))
    got = df.select("id", spatial.nearest_on_triangle(vec.p3(F.col("x"), F.col("y"), F.col("z")), lit(a), lit(b), lit(c)).alias("q")).collect()
    u, v = np.meshgrid(np.linspace(0, 1, 201), np.linspace(0, 1, 201))
    ok = u + v <= 1
    grid = a + u[ok][:, None] * (b - a) + v[ok][:, None] * (c - a)
    for row in got:
        p = pts[row.id]
        assert abs(math.dist(p, (row.q.x, row.q.y, row.q.z)) - np.sqrt(((grid - p) ** 2).sum(axis=1)).min()) < 0.01


def test_fluid_files(spark, tmp_path):
    rows = [(i, *(float(np.float32(i + k / 9)) for k in range(9))) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in fluid.NAMES))
    fluid.write(df, str(tmp_path / "p.fluid"), 204.5)
    spark.dataSource.register(fluid.FluidSource)
    back = sorted(spark.read.format("fluid").load(str(tmp_path / "p.fluid")).collect())
    assert [(r.id, *(r[n] for n in fluid.NAMES)) for r in back] == rows and back[0].per_metre == 204.5
    (tmp_path / "bad.fluid").write_bytes((tmp_path / "p.fluid").read_bytes()[:-4])
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("fluid").load(str(tmp_path / "bad.fluid")).collect()


def test_streamed_gather(spark, tmp_path):
    m = spark.createDataFrame([(s, d, float(v)) for s in range(2) for d in range(3) for v in range(4 if d < 2 else 2)], "stage long, dst long, value double")
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = gather.gather_stream(stream, 4).writeStream.format("memory").queryName("full").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("full").collect())) == [(s, d, 4, 6.0) for s in range(2) for d in range(2)]
