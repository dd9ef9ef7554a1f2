"""Every registered query equals its DuckDB counterpart, and its plan forms no pairs."""

import pytest

from checks import ORACLE, QUERIES
from checks.base import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(spark, SF, name, df) in (None, "both empty")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
