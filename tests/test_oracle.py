"""Every query with SQL gives the rows of that SQL on the smallest tables, by a
plan that would hold on large ones."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver
from compare import check, oracle
from panelkit.constants import FOREST
from panelkit.operators.forecast import FORECAST_FOREST

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(autouse=True, scope="module")
def small_forests():
    """The queries use forests at full strength; here a few trees are enough."""
    full = [(f, dict(f)) for f in (FOREST, FORECAST_FOREST)]
    FOREST.update(numTrees=5, maxDepth=8)
    FORECAST_FOREST.update(numTrees=3, maxDepth=4)
    yield
    for settings, before in full:
        settings.update(before)


@pytest.fixture(scope="module")
def duck():
    return oracle(SF_DIR)


def unsuitable(plan: str) -> list[str]:
    """Plan nodes that pair all rows, leave the JVM, or order a whole table in one task."""
    found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas", plan)
    for line in plan.splitlines():
        # A window lists its partition columns in its last brackets but one, if any.
        if re.search(r"\bWindow \[", line) and re.search(r"windowspecdefinition\(specifiedwindowframe", line):
            found.append("Window without partition")
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    assert unsuitable(df._jdf.queryExecution().executedPlan().toString()) == []
    status = check(duck, df, SQL[name])
    assert status.startswith("ok"), status


# Joins as they run when no side is small enough to broadcast.
@pytest.mark.parametrize("name", [
    "build_panel", "map_frame", "event_paths", "join_baselines", "null_safe_join", "latest_week_report",
    "metro_scorecard", "apply_patch_state_day", "box_stats", "classification_report", "extreme_rows",
])
def test_rows_equal_the_sql_without_broadcasts(spark, duck, name):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        df = QUERIES[name](spark, SF_DIR)
        assert unsuitable(df._jdf.queryExecution().executedPlan().toString()) == []
        status = check(duck, df, SQL[name])
    finally:
        spark.conf.set(setting, before)
    assert status.startswith("ok"), status


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = driver.entry(spark)
    assert {"year", "week", "weekly_sum_jam", "change_from_prior_jam"} <= set(df.columns)
    assert df.count() > 0
