"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import connect, duck_rows, spark_rows

from braidlake.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    assert spark_rows(registry.QUERIES[name](spark, DATA)) == duck_rows(duck, registry.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(e.queries())


def test_plans(spark):
    plan = lambda n: registry.QUERIES[n](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100)" in plan("range_scan")
    assert "TakeOrderedAndProject" in plan("top_n")
    assert "Window" not in plan("win_over_empty")
    assert "Cartesian" not in plan("anti_join_null_aware")
