"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import archspan.plans.registry as registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows(data):
    return sorted(tuple(str(v) for v in r) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, views, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = views.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert rows(df.select(*columns).collect()) == rows(want.select(*columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and all(len(r) == len(df.columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_query_joins_all_pairs(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
