"""Every registered query runs without a cross join; oracles agree in every value."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, plan
    if name in ORACLE:
        problem = compare(name, df, ORACLE[name], con)
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["state", "ba_code", "dc_count", "total", "region_share"]
    assert df.count() == 10
