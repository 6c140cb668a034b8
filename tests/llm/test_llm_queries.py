import pytest
from compare import connect, duck_rows, spark_rows

from braidlake.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == duck_rows(connect(DATA), ORACLE[name])


def test_native_plans(spark):
    for name in ("op7_license_scan", "op9_url_filter", "op10_source_mix"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))
