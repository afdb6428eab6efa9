from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelkit.operators import baseline, compare, keys, metro, panel, patch, quality, reshape

D1, D2 = date(2020, 3, 1), date(2020, 3, 2)


def cells(spark, data):
    return spark.createDataFrame(data, "fips string, date date, alert_type string, count long")


@pytest.fixture
def counts(spark):
    return cells(spark, [
        ("01", D1, "ACCIDENT", 3), ("01", D1, "JAM", None),
        ("01", D2, "JAM", None),  # a day on which nothing is known
        ("02", D2, "ACCIDENT", 0),
        ("99", D1, "JAM", 5),  # a code without a name
    ])


@pytest.fixture
def places(spark):
    return spark.createDataFrame([("01", "A", "x"), ("02", "A", "y"), ("03", "B", "z")],
                                 "fips string, state string, county string")


def test_known_places_need_a_source_and_a_name(counts, places):
    assert [r[0] for r in rows(panel.known_places(places, "fips", counts))] == ["01", "02"]


def test_grid_size_is_the_product_and_counts_stay(counts, places):
    known = panel.known_places(places, "fips", counts)
    grid = panel.complete_grid(counts, known)
    assert grid.count() == 2 * 2 * 2
    filled = panel.fill_true_zeros(grid, "count", ["fips", "date"])
    assert rows(filled) == [
        ("01", D1, "ACCIDENT", 3), ("01", D1, "JAM", 0),
        ("01", D2, "ACCIDENT", None), ("01", D2, "JAM", None),
        ("02", D1, "ACCIDENT", None), ("02", D1, "JAM", None),
        ("02", D2, "ACCIDENT", 0), ("02", D2, "JAM", 0),
    ]
    assert rows(panel.complete_panel(counts, known)) == rows(filled)


def test_fill_from_first_observed(spark):
    df = spark.createDataFrame([(D1, None, None), (D2, 4, None), (D2 + timedelta(1), None, 1)],
                               "date date, cases long, deaths long")
    out = panel.fill_from_first_observed(df, "date", ["cases", "deaths"])
    assert [tuple(r)[1:] for r in out.orderBy("date").collect()] == [(None, None), (4, 0), (0, 1)]


def test_daily_counts_are_strict_and_drop_unknown_places(spark):
    events = spark.createDataFrame(
        [("01", "001", D1, "JAM", 1), ("01", "001", D1, "JAM", 2), ("01", "001", D2, "JAM", 1),
         ("01", "001", D2, "JAM", None), (None, "001", D1, "JAM", 9)],
        "s string, c string, date date, alert_type string, count long")
    out = panel.daily_counts(events, F.concat("s", "c"), "date", "alert_type", "count")
    assert rows(out) == [("01001", D1, "JAM", 3), ("01001", D2, "JAM", None)]


def test_key_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("aab", "bc"))
    assert rows(keys.key_difference(a, b, ["k"])) == [("a", "left"), ("c", "right")]
    with pytest.raises(ValueError):
        keys.assert_same_keys(a, b, ["k"])
    keys.assert_same_keys(a, a.distinct(), ["k"])


def test_null_keys_match(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    assert rows(keys.null_safe_join(a, b, ["k"])) == [(None, 1, 10), ("x", 2, 20), ("y", 3, None)]


def test_zero_fill_days(spark):
    events = spark.createDataFrame([("p", D1, 2, "n1"), ("p", D1, 1, "n1"), ("q", D2, 4, "n2")],
                                   "geoid string, date date, count long, name string")
    out = panel.zero_fill_days(events, "geoid", "date", "count", ["name"])
    assert rows(out.select("geoid", "date", "name", "sum_count", "samp")) == [
        ("p", D1, "n1", 3, 2), ("p", D2, "n1", 0, 0), ("q", D1, "n2", 0, 0), ("q", D2, "n2", 4, 1)]


def test_weeks_need_their_neighbours(spark):
    sundays = [date(2019, 12, 29), date(2020, 12, 27), date(2021, 1, 3), date(2021, 1, 17)]
    data = cells(spark, [("01", d, "JAM", i + 1) for i, d in enumerate(sundays)])
    out = panel.weekly_panel(data, ["fips"], kinds=("JAM",)).orderBy("year", "week")
    got = [(r.year, r.week, r.week_sum_JAM, r.prior_year_JAM, r.prev_week_JAM) for r in out.collect()]
    assert got == [
        (2020, 1, 1, None, None),
        (2020, 53, 2, None, None),
        (2021, 1, 3, 1, 2),  # the week before is week 53 of the year before
        (2021, 3, 4, None, None),  # week 2 is missing
    ]


def test_kind_without_rows_is_null_and_unknown_counts_are_zero(spark):
    data = cells(spark, [("01", D1, "JAM", None)])
    wide = reshape.widen_sums(data, ["fips"], "alert_type", "count", "sum", ("JAM", "ACCIDENT"))
    assert rows(wide) == [("01", 0, None)]


def test_last_complete_day(spark):
    data = cells(spark, [("01", D1, "JAM", 4), ("02", D1, "JAM", None), ("01", D2, "JAM", None)])
    assert rows(panel.last_complete_day(data)) == [(D1, 4, 1, 1)]


def test_long_paths_join_their_runs_in_order(spark):
    n = 2500
    points = spark.range(n).select((F.col("id") % 3 == 0).cast("int").alias("p"), F.col("id").alias("seq"),
                                   F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    good = spark.createDataFrame([(1,)], "p int")
    out = metro.event_paths(points, good, "p", "seq", F.col("x"), F.col("y"), run_length=100).collect()
    expected = ",".join(f"{i} {2 * i}" for i in range(0, n, 3))
    assert [tuple(r) for r in out] == [(1, 834, f"LINESTRING({expected})")]


def test_map_frame_of_an_empty_selection(spark):
    vertices = spark.createDataFrame([("01", 1, i, float(i), 0.0) for i in range(3)],
                                     "fips string, group int, ord int, long double, lat double")
    counts = spark.createDataFrame([(1, D1, "01", "FLOOD", 1, 7)],
                                   "st int, date date, fips string, sub_type string, total_count long, sum_counts long")
    assert metro.map_frame(vertices, counts, ("st", 1), "2020-03-01", "FIRE").collect() == []
    frame = metro.map_frame(vertices, counts, ("st", 1), "2020-03-01", "FLOOD").orderBy("ord").collect()
    assert [(r.ord, r.min_long, r.max_long, r.largest_count) for r in frame] == [(i, 0.0, 2.0, 7) for i in range(3)]


# Impact indices and suppression.

WIDE = "fips string, count_ACCIDENT long, count_JAM long, count_WEATHERHAZARD long," \
       " pred_count_ACCIDENT double, pred_count_JAM double, pred_count_WEATHERHAZARD double"


def test_index_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", 2, 4, 6, 1.0, 2.0, 3.0), ("b", 2, 4, 6, 0.0, 2.0, 3.0), ("c", None, 4, 6, 1.0, 2.0, 3.0)], WIDE)
    out = {r.fips: (r.impact_crash, r.impact_jam, r.impact_weh, r.impact_index) for r in baseline.impact_index(df).collect()}
    assert out == {"a": (1.0, 1.0, 1.0, 1.0), "b": (None, 1.0, 1.0, None), "c": (None, 1.0, 1.0, None)}


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, 0.2, 0.5, 0.49), ("b", 1, 1, 1, 0.19, None, 0.5)], WIDE)
    out = baseline.threshold_predictions(df).orderBy("fips").collect()
    assert [tuple(r)[4:] for r in out] == [(0.2, 0.5, 0.0), (0.0, None, 0.5)]


def test_rounded_predictions(spark):
    df = spark.createDataFrame([("a", 4, 1, 1, 1.5, 0.4, 1.0)], WIDE)
    r = baseline.impact_rounded(df).first()
    assert (r.impact_crash_rnd, r.impact_jam_rnd, r.impact_index_rnd) == (1.0, None, None)


def test_small_totals_only_turn_to_null(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, 3.0, 3.0, 3.9), ("b", 1, 1, 1, 3.0, 3.0, 4.0), ("c", 1, 1, 1, None, 3.0, 1.0)], WIDE)
    out = baseline.suppress_small_totals(df, "pred_count").orderBy("fips").collect()
    assert [r.pred_count_JAM for r in out] == [None, 3.0, 3.0]
    assert [r.pred_count_JAM_nf for r in out] == [3.0, 3.0, 3.0]
    kept = baseline.sufficient_rows(baseline.suppress_small_totals(df, "pred_count"), [], "pred_count_total").first()
    assert tuple(kept) == (3, 2)


def test_small_cells_keep_the_minimum(spark):
    df = spark.createDataFrame([(10.0,), (9.9,), (None,)], "x double")
    assert [r[0] for r in baseline.suppress_small_cells(df, ["x"]).collect()] == [10.0, None, None]


# Comparison.

def state_weeks(spark, data):
    return spark.createDataFrame(data, "state string, year int, week int, week_sum_JAM long, prior_year_JAM long,"
                                       " prev_week_JAM long, window_mean_JAM double")


def test_weighted_change_equals_the_change_of_sums(spark):
    weeks = state_weeks(spark, [("A", 2020, 9, 30, 20, 10, 5.0), ("B", 2020, 9, 50, 80, 40, 45.0), ("C", 2020, 9, 7, 0, 1, 2.0)])
    r = compare.national_week_index(weeks).first()
    assert r.weekly_sum_jam == 87 and r.weekly_prior_jam == 100
    assert r.pct_jam_prev_week == pytest.approx(100 * (87 - 51) / 51)
    assert r.pct_jam_window == pytest.approx(100 * (87 - 52) / 52)
    # The state without a prior year has weight 0 and does not count.
    assert r.pct_jam_prior_year == pytest.approx(100 * (80 - 100) / 100)


def test_shares_sum_to_one(spark):
    weeks = state_weeks(spark, [("A", 2020, 9, 30, 20, 10, 5.0), ("B", 2020, 9, 50, 80, 40, 45.0), ("A", 2020, 10, 1, 0, 0, 0.0)])
    out = compare.week_share_weights(weeks, ("JAM",)).groupBy("week").agg(F.sum("weight_jam_prior_year")).orderBy("week")
    assert [r[1] for r in out.collect()] == [pytest.approx(1.0), None]


def test_trough_and_peak_ties_and_years(spark):
    totals = [(2020, 5, 0), (2020, 10, 50), (2020, 40, 7), (2021, 3, 7), (2020, 20, 90), (2021, 9, 60), (2021, 2, 60)]
    weeks = spark.createDataFrame(totals, "year int, week int, weekly_sum_jam long")
    low = compare.trough(weeks, 2020, "weekly_sum_jam")
    assert tuple(low.first()) == (2020, 40, 7)
    assert tuple(compare.peak_after(weeks, low, "weekly_sum_jam").first()) == (2021, 2, 60)


def test_week_ending_of_complete_weeks(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2020-12-21', DATE'2021-01-04')) AS date")
    assert rows(compare.week_ending_lookup(days)) == [(2020, 53, date(2021, 1, 2))]


def test_cap_is_strict(spark):
    df = spark.createDataFrame([(6, 1.0), (599, 100.0), (3, 0.0), (0, 4.0)], "count_JAM long, prior_mean_JAM double")
    out = compare.capped_change_day(df, ("JAM",)).collect()
    assert [r.pct_jam for r in out] == [None, 499.0, None, -100.0]
    assert out[2].prior_mean_JAM is None


def test_top_periods_prefers_the_earlier_of_equals(spark):
    df = spark.createDataFrame([("a", h, c) for h, c in [(3, 5), (1, 5), (2, 9), (4, 1)]], "g string, hour int, count long")
    out = compare.top_periods(df, ["g"], "hour", "count", 2)
    assert [(r.hour, r["rank"]) for r in out.orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_reference_counties_check(spark):
    listed = spark.createDataFrame([("01", "x", 1), ("01", "other", 2), ("07", "z", 1)], "fips string, name string, line int")
    events = cells(spark, [("01", D1, "JAM", 1), ("02", D1, "JAM", 1)])
    out = compare.reference_counties(events, listed, "fips", "line")
    assert [(r.fips, r.name, r.ym) for r in out.collect()] == [("01", "x", "2020-03")]
    with pytest.raises(ValueError):
        compare.reference_counties(events, listed, "fips", "line", check=True)


# Patching and quality.

def test_patch_leaves_other_states_alone(spark):
    target = spark.createDataFrame([("A", "05", 1, 9.0), ("B", "05", 1, 9.0), ("A", "06", 1, 9.0)],
                                   "state string, month string, dow int, prior_mean_JAM double")
    substitute = spark.createDataFrame([("A", "05", 1, 20.0), ("B", "05", 1, 30.0), ("A", "06", 1, None)],
                                       "state string, month string, dow int, substitute_JAM double")
    out = patch.apply_patch(target, substitute, ["state", "month", "dow"], ["A"], "prior_mean", ("JAM",))
    assert rows(out) == [("A", "05", 1, 20.0), ("A", "06", 1, 9.0), ("B", "05", 1, 9.0)]


def test_fall_to_zero_counts_as_a_jump(spark):
    days = [(D1 + timedelta(i), c) for i, c in enumerate([4, 0, 0, 2])]
    df = spark.createDataFrame([("m", d, c) for d, c in days], "metro string, date date, count_JAM long")
    out = quality.day_over_day_change(df, "metro", ("JAM",)).orderBy("date").collect()
    assert [(r.change_jam, r.infinite_change) for r in out] == [(None, False), (None, True), (None, False), (1.0, False)]
    again = quality.day_over_day_change(df, "metro", ("JAM",), relative_to="previous").orderBy("date").collect()
    assert [(r.change_jam, r.infinite_change) for r in again] == [(None, False), (-1.0, False), (None, False), (None, True)]
    jumps = quality.volatility_by_metro(quality.day_over_day_change(df, "metro", ("JAM",)), "metro").first()
    assert tuple(jumps) == ("m", 1, 1, 1)


def test_gaps(spark):
    months = [(date(2020, 1, 1), 1), (date(2020, 2, 1), None), (date(2020, 5, 1), 2)]
    df = spark.createDataFrame([("s", m, v) for m, v in months], "s string, period date, value int")
    assert rows(quality.gap_report(df, ["s"], "period", "value")) == [
        ("s", date(2020, 2, 1), "null"), ("s", date(2020, 3, 1), "missing"), ("s", date(2020, 4, 1), "missing")]


def test_spot_check(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "k int, v int")
    b = spark.createDataFrame([(1, 1), (2, 5), (4, None)], "k int, v int")
    out = keys.spot_check(a, b, ["k"], ["v"])
    assert rows(out) == [(1, 1, 1, "same"), (2, None, 5, "differs"), (3, 3, None, "only_left"), (4, None, None, "only_right")]
