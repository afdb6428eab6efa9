"""NULL keys, gaps, repeated keys and rounding on hand-made rows."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelkit.functions import nulls
from panelkit.operators import forecast, keys, panel, patch, quality
from panelkit.operators.compare import metro_scorecard
from panelkit.operators.reshape import widen


@pytest.mark.parametrize("value, digits, expected", [
    (0.4999999999, 0, 0.0), (1.04999999, 1, 1.0), (1.005, 2, 1.01), (0.15, 1, 0.2), (1e25, 1, 1e25), (-0.5, 0, -1.0), (2.5, 0, 3.0), (None, 1, None),
])
def test_values_are_rounded_once(spark, value, digits, expected):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(nulls.rounded("x", digits)).first()[0] == expected


@pytest.fixture(scope="module")
def two(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    return left, spark.createDataFrame([(None, 9), ("a", 8), ("c", 7)], "k string, w int")


def test_null_keys_match(two):
    left, right = two
    assert rows(keys.natural_join(left, right)) == rows(left.sparkSession.createDataFrame(
        [(None, 1, 9), ("a", 2, 8), ("b", 3, None)], "k string, v int, w int"))
    full = keys.natural_join(left, right, "full_outer")
    assert {tuple(r) for r in full.collect()} == {(None, 1, 9), ("a", 2, 8), ("b", 3, None), ("c", None, 7)}
    assert {tuple(r) for r in keys.key_difference(left, right, ["k"]).collect()} == {("b", "left"), ("c", "right")}
    keys.assert_same_keys(left, left, ["k"])
    spots = keys.spot_check(left.withColumnRenamed("v", "n"), right.withColumnRenamed("w", "n"), ["k"], ["n"])
    assert {(r.k, r.status) for r in spots.collect()} == {(None, "differs"), ("a", "differs"), ("b", "only_left"), ("c", "only_right")}


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 5.0), ("a", 2.0), ("a", None)], "g string, x double")
    assert {tuple(r) for r in keys.extreme_rows(df, ["g"], "x").collect()} == {(None, 5.0), ("a", 2.0)}
    assert {(r.g, r["median"]) for r in quality.box_stats(df, "x", ["g"]).collect()} == {(None, 3.0), ("a", 2.0)}


def test_numeric_summary_counts_nulls(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "x double")
    r = quality.numeric_summary(df, "x").first()
    assert (r["min"], r["median"], r["mean"], r["max"], r["n_null"]) == (1.0, 1.0, 2.0, 4.0, 1)


def test_gaps_have_no_difference(spark):
    series = spark.createDataFrame([("s", date(2020, m, 1), float(m)) for m in (1, 2, 4, 5, 6)], "s string, period date, value double")
    logs = forecast.log_diff(series, ["s"])
    assert sorted(r.period.month for r in logs.collect()) == [2, 5, 6]
    assert [r.period.month for r in forecast.lag_embed(logs, ["s"], 1).collect()] == [6]


def _fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_repeated_keys_are_errors(spark):
    target = spark.createDataFrame([("x", 1, 2)], "state string, prior_A long, day int")
    substitute = spark.createDataFrame([("x", 5), ("x", 6)], "state string, substitute_A long")
    _fails(patch.apply_patch(target, substitute, ["state"], ["x"], "prior", ["A"]), "repeated key")
    good = patch.apply_patch(target, substitute.limit(1), ["state"], ["x"], "prior", ["A"])
    assert good.columns == target.columns and good.count() == 1
    measure = spark.createDataFrame([("x", 1), ("x", 1)], "state string, cases int")
    _fails(panel.attach_measure(target, measure, ["state"]), "repeated key")
    long = spark.createDataFrame([("p", "A", 1), ("p", "A", 2), ("p", "B", 3)], "p string, kind string, n int")
    _fails(widen(long, ["p"], "kind", {"n": "n"}, ["A", "B"]), "several rows")
    assert widen(long.where("n > 1"), ["p"], "kind", {"n": "n"}, ["A", "B"]).first()[1:] == (2, 3)


def test_an_area_that_stopped_has_no_current_numbers(spark):
    day = spark.createDataFrame(
        [("T", "old", date(2020, 1, 1), 1.0, 1.0), ("T", "new", date(2020, 1, 2), 2.0, 2.0)],
        "state string, csa_title string, date date, pct_crash double, pct_jam double")
    week = day.select("state", "csa_title", F.lit(2020).alias("year"), F.dayofmonth("date").alias("week"), "pct_crash", "pct_jam",
                      F.col("pct_crash").alias("pct_crash_prev"), F.col("pct_jam").alias("pct_jam_prev"))
    assert metro_scorecard(day, week, "T", "old").count() == 0
    assert metro_scorecard(day, week, "T", "new").count() == 3


def test_the_entry_stays_where_a_library_of_the_text_queries_is_missing():
    """In a process of its own: without one of their libraries the text queries are left out, and all others are there."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['ahocorasick'] = None\n"
        "import __spark_entry__ as e; from panelkit.plans.catalog import QUERIES; print(set(e.queries()) == set(QUERIES))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "True"
