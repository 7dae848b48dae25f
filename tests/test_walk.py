"""The walk over graphs with sinks, loops and repeated edges."""

import pytest

from weftline.operators import ranking


def by_hand(edges, trips, keep):
    rank = {v: 1.0 for e in edges for v in e}
    out = {v: sum(s == v for s, _ in edges) for v in rank}
    for _ in range(trips):
        rank = {v: keep * r + sum((1 - keep) * rank[s] / out[s] for s, d in edges if d == v) for v, r in rank.items()}
    return rank


@pytest.mark.parametrize("both_ways", [False, True])
def test_edges_are_shuffled_once(spark, monkeypatch, both_ways):
    """Failed before: degrees, vertices and weights took a shuffle of all edges each."""
    edges = [(1, 2), (2, 1), (2, 3), (3, 2), (2, 3), (3, 2), (4, 4)] + ([] if both_ways else [(1, 5), (6, 1)])
    plans = []
    real = ranking.checkpoint
    monkeypatch.setattr(ranking, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    df = spark.createDataFrame(edges, "src long, dst long")
    got = ranking.walk(df, 2, both_ways=True) if both_ways else ranking.walk(df, 2)
    assert {r.v: pytest.approx(r.rank) for r in got.collect()} == by_hand(edges, 2, ranking.KEEP)
    assert "InMemoryTableScan" in plans[0] and "Join [" in plans[0] and ("REPARTITION_BY_NUM" in plans[0])
