"""Registered queries against their SQL, and the shape of their plans."""

import pytest

from lakewarden.plans.registry import ORACLES, QUERIES
from tests.oracle_compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"

# No product of two tables, no nested loops, no row-at-a-time Python.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas"]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    plans = []

    def query(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    assert compare(spark, con, SF_DIR, query, ORACLES[name]) is None
    for operator in FORBIDDEN:
        assert operator not in plans[0]
