"""Every registered query of the core against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from weftline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their trips or block sizes are set for another scale.
OTHER_SCALE = {"while_converge"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(cols, data):
    key = lambda r: tuple((v is None, 0 if v is None else v) for v in r)
    return sorted((tuple(r[c] for c in sorted(cols)) for r in data), key=key)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, duck, name):
    if name in OTHER_SCALE:
        pytest.skip("set for another scale")
    df = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows(df.columns, [r.asDict() for r in df.collect()])
    want = rows(rel.columns, [dict(zip(rel.columns, r)) for r in rel.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4), name
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
