"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck_over

import __spark_entry__ as entry
from claimcheck.plans.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duck_over(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    _, _, ok, diff = compare(spark, duck, name, entry.queries(), entry.oracle_sql(), FOLDER)
    assert ok, diff


def test_every_query_has_checking_sql():
    """The optional corpus part tests its own queries, some of which SQL cannot express."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["event_order", "hedge_vs_flat", "place_mentions", "leak_scan", "snapshot_diff", "event_vs_span"])
def test_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
