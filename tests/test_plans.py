"""Properties of physical plans that keep queries safe on large and skewed data."""

import pytest

from checks import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["retention_slice"](spark, SF))
    assert "PushedFilters: [" in text and "LessThan(o_orde" in text
    assert "o_totalprice" not in text
    usage = plan(QUERIES["usage_by_command"](spark, SF))
    assert "GreaterThanOrEqual(ts" in usage


@pytest.mark.parametrize("name", ["latest_observation", "recent_form", "best_win", "practice_history"])
def test_top_rows_are_limited_on_the_map_side(spark, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF))
