"""Front propagation by a level set on a mesh of hexahedra, as joins over nodes, zones and their incidence.

Tables: nodes (gid, x, y, z), zone_node (zone, slot, gid), and a node state (gid, state, level, t).
States: REACHED 1, BAND 2 (narrow band), NEAR 3, UNREACHED 4.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpoint

REACHED, BAND, NEAR, UNREACHED = 1, 2, 3, 4
#: Corners of a zone by slot, and its twelve edges as pairs of slots.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
EDGES = [(a, b) for a, b in itertools.combinations(range(8), 2) if sum(p != q for p, q in zip(CORNERS[a], CORNERS[b])) == 1]


def mesh_nodes(spark, n: int, size: float = 1.0) -> DataFrame:
    """Nodes of n^3 zones over a cube of edge ``size``; gid = (i (n+1) + j) (n+1) + k."""
    m = n + 1
    g = spark.range(m**3).select(F.col("id").alias("gid"), F.floor(F.col("id") / (m * m)).alias("i"), (F.floor(F.col("id") / m) % m).alias("j"), (F.col("id") % m).alias("k"))
    return g.select("gid", *((F.col(a) * size / n).alias(b) for a, b in zip("ijk", "xyz")))


def mesh_zone_nodes(spark, n: int) -> DataFrame:
    """The eight nodes of each zone, by slot."""
    m = n + 1
    z = spark.range(n**3).select(F.col("id").alias("zone"), F.floor(F.col("id") / (n * n)).alias("i"), (F.floor(F.col("id") / n) % n).alias("j"), (F.col("id") % n).alias("k"))
    corner = F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("slot"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for s, (a, b, c) in enumerate(CORNERS))))
    return z.withColumn("q", corner).select("zone", "q.slot", (((F.col("i") + F.col("q.a")) * m + F.col("j") + F.col("q.b")) * m + F.col("k") + F.col("q.c")).alias("gid"))


def zone_centres(nodes: DataFrame, zone_node: DataFrame) -> DataFrame:
    return zone_node.join(nodes, "gid").groupBy("zone").agg(*(F.avg(a).alias(a) for a in "xyz"))


def mesh_extremes(nodes: DataFrame, zone_node: DataFrame) -> DataFrame:
    """One row: the longest and shortest edge, the longest diagonal, and the band: the most, over zones, of a zone's longest edge and diagonal together."""
    zones = zone_node.join(nodes, "gid").groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("slot", "x", "y", "z"))).alias("p"))
    pairs = list(itertools.combinations(range(8), 2))

    def d2(a, b):
        u, v = F.get("p", F.lit(a)), F.get("p", F.lit(b))
        return sum(((u[c] - v[c]) * (u[c] - v[c]) for c in "xyz"), F.lit(0.0))

    edges = [d2(a, b) for a, b in pairs if (a, b) in EDGES]
    each = zones.select(F.sqrt(F.greatest(*edges)).alias("most"), F.sqrt(F.least(*edges)).alias("least"), F.sqrt(F.greatest(*(d2(a, b) for a, b in pairs))).alias("across"))
    return each.agg(F.max("most").alias("max_edge"), F.min("least").alias("min_edge"), F.max("across").alias("max_diagonal"), F.max(F.col("most") + F.col("across")).alias("band"))


def fire_sources(state: DataFrame, nodes: DataFrame, sources: DataFrame, time: float, velocity: float, band: float) -> DataFrame:
    """Nodes whose distance to a fired source's front is at most ``band``, or that are behind it: the least level of all sources.

    Within the band's width they are in the band; those behind the front have the time it passed, and those farther behind than
    the band are reached. ``sources``: cx, cy, cz, radius, delay, a handful given by the problem, so they are broadcast.
    """
    fired = sources.where(F.lit(time) >= F.col("delay") + F.col("radius") / velocity)
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0)))
    level = d - (F.lit(time) - F.col("delay")) * velocity
    near = nodes.join(F.broadcast(fired), level <= band).groupBy("gid").agg(F.min(level).alias("new"))
    out = state.join(near, "gid", "left").withColumn("own", F.when(F.col("new") < band, F.least("level", "new")).otherwise(F.col("level")))
    hit, own = F.col("new").isNotNull(), F.col("own")
    return out.select(
        "gid", F.when(hit & (own < -band), REACHED).when(hit & (F.abs(own) < band), BAND).otherwise(F.col("state")).alias("state"), own.alias("level"),
        F.when(hit & (own < 0), F.greatest(F.lit(0.0), F.lit(time) + own / velocity)).otherwise(F.col("t")).alias("t"),
    )


def surface_zones(state: DataFrame, zone_node: DataFrame, at_band: bool = False) -> DataFrame:
    """Zones that the front crosses: some but not all of the eight levels are negative. ``at_band``: only those with a node in the band."""
    aggs = [F.sum(F.when(F.col("level") < 0, 1).otherwise(0)).alias("n")] + ([F.max((F.col("state") == BAND).cast("int")).alias("b")] if at_band else [])
    return zone_node.join(state, "gid").groupBy("zone").agg(*aggs).where("n > 0 and n < 8" + (" and b = 1" if at_band else "")).select("zone")


def surface_nodes(state: DataFrame, zone_node: DataFrame) -> DataFrame:
    """The nodes of the surface zones at the band: ``gid``."""
    return zone_node.join(surface_zones(state, zone_node, True), "zone", "left_semi").select("gid").distinct()


def narrow_band(state: DataFrame, zone_node: DataFrame) -> DataFrame:
    """Band nodes behind the front that touch no surface zone leave the band and are reached. None joins it here: that is nearby() and promote()."""
    s = state.join(surface_nodes(state, zone_node).withColumn("on", F.lit(True)), "gid", "left")
    new = F.when(F.col("on").isNull() & (F.col("state") == BAND) & (F.col("level") < 0), REACHED).otherwise(F.col("state"))
    return s.select("gid", new.alias("state"), "level", "t")


def nearby(state: DataFrame, zone_node: DataFrame) -> DataFrame:
    """Nodes two hops from the surface (zones around the surface zones' nodes), outside and not in the band, are near."""
    first = surface_nodes(state, zone_node)
    zones = zone_node.join(first, "gid", "left_semi").select("zone").distinct()
    second = zone_node.join(zones, "zone", "left_semi").select("gid").distinct().withColumn("on", F.lit(True))
    s = state.join(second, "gid", "left")
    return s.select("gid", F.when(F.col("on") & ~F.col("state").isin(BAND, REACHED) & (F.col("level") >= 0), NEAR).otherwise(F.col("state")).alias("state"), "level", "t")


def promote(state: DataFrame) -> DataFrame:
    return state.withColumn("state", F.when(F.col("state") == NEAR, BAND).otherwise(F.col("state")))


def next_step(state: DataFrame, zone_node: DataFrame, velocity: float, last: float, min_edge: float) -> DataFrame:
    """One row, ``dt``: half the least time until the front meets a band node, at most 1.05 times the last; nearly an edge's time where none waits.

    Nodes of surface zones, and levels up to a quarter of the shortest edge, are too close to the front to count.
    """
    waits = state.join(surface_nodes(state, zone_node), "gid", "left_anti").where((F.col("state") == BAND) & (F.col("level") > 0.25 * min_edge))
    return waits.agg(F.min(F.col("level") / velocity).alias("a")).select(F.coalesce(F.least(F.lit(1.05 * last), 0.5 * F.col("a")), F.lit((1 - 1e-6) * min_edge / velocity)).alias("dt"))


def advance(state: DataFrame, dt: float, velocity: float, time: float) -> DataFrame:
    """Band levels fall by velocity dt; a node that crosses zero is reached at time + level / velocity."""
    new = F.col("level") - velocity * dt
    crossed = (F.col("state") == BAND) & (F.col("level") >= 0) & (new < 0)
    return state.select("gid", "state", F.when(F.col("state") == BAND, new).otherwise(F.col("level")).alias("level"), F.when(crossed, F.lit(time) + F.col("level") / velocity).otherwise(F.col("t")).alias("t"))


def spread(nodes: DataFrame, zone_node: DataFrame, sources: DataFrame, velocity: float, trips: int) -> tuple[DataFrame, float, int]:
    """The whole loop at one velocity: the node state after ``trips`` steps or when no node is left to reach, the time, and the steps made.

    A step fires the sources whose time has come, narrows the band, takes nodes near the surface into it, and advances by
    the next time step. The state is checkpointed twice a step; what comes to the driver is one row.
    """
    m = mesh_extremes(nodes, zone_node).first()
    far = 1e9
    state = nodes.select("gid", F.lit(UNREACHED).alias("state"), F.lit(far).alias("level"), F.lit(far).alias("t"))
    waiting, time, dt, made = sources, 0.0, (1 - 1e-6) * m.min_edge / velocity, 0
    for _ in range(trips):
        due = F.lit(time) >= F.col("delay") + F.col("radius") / velocity
        fired = fire_sources(state, nodes, waiting, time, velocity, m.band)
        waiting = waiting.where(~due)
        state = narrow_band(checkpoint(fired), zone_node)
        level = _image_levels(state, nodes, sources, time, velocity)
        state = checkpoint(promote(nearby(level, zone_node)))
        dt = next_step(state, zone_node, velocity, dt, m.min_edge).first().dt
        state = advance(state, dt, velocity, time)
        time, made = time + dt, made + 1
        if state.where((F.col("state") != REACHED) & (F.col("level") >= 0)).isEmpty():
            break
    return state, time, made


def _image_levels(state: DataFrame, nodes: DataFrame, sources: DataFrame, time: float, velocity: float) -> DataFrame:
    """Levels of nodes that no front has come near yet, from the closest front of a fired source: at one velocity that is their image point's."""
    fired = sources.where(F.lit(time) >= F.col("delay") + F.col("radius") / velocity)
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0)))
    got = nodes.join(F.broadcast(fired)).groupBy("gid").agg(F.min(d - (F.lit(time) - F.col("delay")) * velocity).alias("new"))
    s = state.join(got, "gid", "left")
    return s.select("gid", "state", F.when(F.col("state").isin(NEAR, UNREACHED), F.coalesce("new", "level")).otherwise(F.col("level")).alias("level"), "t")


def error_norms(state: DataFrame) -> DataFrame:
    """Over reached times: count, mean, mean square, most."""
    got = state.where(F.col("t").isNotNull()).agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("q"), F.max("t").alias("most"))
    return got.select("n", (F.col("s") / F.col("n")).alias("mean"), (F.col("q") / F.col("n")).alias("mean_square"), "most")


def _facet(zone: pd.DataFrame) -> pd.DataFrame:
    """The polygons of the front in one zone: crossed edges, walked around through shared faces."""
    p = zone.sort_values("slot")
    level, at = p["level"].to_numpy(), p[["x", "y", "z"]].to_numpy()
    cut = {e: at[e[0]] + (at[e[1]] - at[e[0]]) * (level[e[0]] / (level[e[0]] - level[e[1]])) for e in EDGES if (level[e[0]] < 0) != (level[e[1]] < 0)}
    faces = [[e for e in EDGES if all(CORNERS[s][a] == v for s in e)] for a in range(3) for v in (0, 1)]
    links: dict = {e: [] for e in cut}
    for face in faces:
        own = [e for e in face if e in cut]
        if len(own) == 4:  # a saddle: each inside corner keeps its own two edges
            own.sort(key=lambda e: min(s for s in e if level[s] < 0))
        for u, v in zip(own[::2], own[1::2]):
            links[u].append(v)
            links[v].append(u)
    out, left = [], set(cut)
    while left:
        ring, here = [], min(left)
        while here is not None:
            ring.append(here)
            left.discard(here)
            here = next((e for e in links[here] if e in left), None)
        if len(ring) > 2:
            pts = [cut[e] for e in ring]
            out.append((int(p["zone"].iloc[0]), len(out), [{"x": float(a), "y": float(b), "z": float(c)} for a, b, c in pts], *(float(sum(q[i] for q in pts) / len(pts)) for i in range(3))))
    return pd.DataFrame(out, columns=["zone", "facet", "vertices", "cx", "cy", "cz"])


def front(state: DataFrame, nodes: DataFrame, zone_node: DataFrame, min_edge: float) -> DataFrame:
    """Polygons of the front by zone; a group is a zone's eight nodes. Levels next to zero count as inside."""
    tiny = 1e-12 * min_edge
    snapped = state.select("gid", F.when(F.abs("level") < tiny, -tiny).otherwise(F.col("level")).alias("level"))
    rows = zone_node.join(surface_zones(snapped, zone_node), "zone", "left_semi").join(snapped, "gid").join(nodes, "gid")
    return rows.groupBy("zone").applyInPandas(_facet, "zone long, facet int, vertices array<struct<x:double,y:double,z:double>>, cx double, cy double, cz double")


def owners(shared: DataFrame) -> DataFrame:
    """The least domain that shares a node owns it: ``gid, domain`` rows to ``gid, owner, sharers``."""
    return shared.groupBy("gid").agg(F.min("domain").alias("owner"), F.count("*").alias("sharers"))
