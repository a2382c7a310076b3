"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracles import compare, database

from surveykit.workloads import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare(df, con, ORACLES[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
