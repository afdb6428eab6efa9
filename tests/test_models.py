"""Forests are compared with simple expectations, within a tolerance."""

from __future__ import annotations

import math
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from panelkit.operators import baseline, expected, forecast
from panelkit.plans import model_queries


@pytest.fixture(scope="module")
def panel(spark):
    """Two states with a strong weekday effect and a level per place."""
    days = spark.sql("SELECT explode(sequence(DATE'2018-01-01', DATE'2020-02-29')) AS date")
    place = F.explode(F.array(*[F.struct(F.lit(f).alias("fips"), F.lit(s).alias("state"), F.lit(level).alias("level"))
                                for f, s, level in (("01", "A", 10), ("02", "A", 100), ("03", "B", 50))]))
    df = days.select("date", place.alias("p")).select("date", "p.*")
    count = F.col("level") + F.when(F.dayofweek("date").isin(1, 7), 0).otherwise(F.col("level"))
    return df.select("fips", "state", F.col("fips").alias("county"), "date", F.lit("JAM").alias("alert_type"),
                     count.cast("long").alias("count"))


@pytest.fixture(scope="module")
def fit(panel):
    forest = {"numTrees": 5, "featureSubsetStrategy": "8", "minInstancesPerNode": 5, "maxDepth": 6}
    return expected.fit_expected(panel, 2020, forest=forest)


def test_predicts_every_target_row(panel, fit):
    assert fit.predictions.count() == panel.where(F.year("date") == 2020).count() == 3 * 60
    assert fit.predictions.where("pred_count < 0 OR pred_count IS NULL").count() == 0


def test_learns_place_and_weekday(fit):
    worst = fit.predictions.agg(F.max(F.abs(F.col("count") - F.col("pred_count")) / F.col("count"))).first()[0]
    assert worst < 0.1


def test_one_model_per_group_with_metrics(fit):
    assert set(fit.models) == {("A", "JAM"), ("B", "JAM")}
    metrics = {r.model: r for r in expected.model_metrics(fit).collect()}
    assert set(metrics) == {"A_JAM", "B_JAM"}
    for r in metrics.values():
        assert r.n_fit > r.n_test > 0 and r.mse >= 0 and r.runtime > 0
        assert r.n_fit == (r.n_fit + r.n_test) * 7 // 10


def test_split_is_stable_and_thinned(spark):
    rows = spark.range(20000).withColumn("x", F.when(F.col("id") % 10 != 0, F.col("id")))
    split = expected.split_train_test(rows, ["x"], expected.in_test(["id"]), thin=expected.in_test(["x"], 0.5))
    kept, tested = split.agg(F.count(F.lit(1)), F.count_if("is_test")).first()
    assert split.where("x IS NULL").count() == 0
    assert 8000 < kept < 10000 and 0 < tested < kept
    again = expected.split_train_test(rows.repartition(3), ["x"], expected.in_test(["id"]))
    assert 0.28 < again.where("is_test").count() / again.count() < 0.32
    assert split.where("is_test").join(again.where("is_test"), "id").count() == tested


def test_compiled_columns(fit):
    df = expected.compile_predictions(fit.predictions)
    assert df.columns[:6] == ["date", "state", "county", "alert_type", "count", "pred_count"]


def test_direct_forecast_follows_a_seasonal_pattern(spark):
    months = [(s, date(2010 + m // 12, m % 12 + 1, 1), m) for s in "ab" for m in range(120)]
    series = spark.createDataFrame(months, "series string, period date, m int").select(
        "series", "period", (100 + 50 * F.sin(F.col("m") * 2 * math.pi / 12)).alias("value"))
    logs = forecast.log_diff(series, ["series"])
    steps = forecast.direct_forecast(logs, ["series"], "2018-12-01",
                                     forest={"numTrees": 10, "minInstancesPerNode": 1, "maxDepth": 8})
    assert steps.count() == 2 * 12
    values = forecast.back_transform(steps, forecast.last_values(series, ["series"], "2018-12-01"), ["series"])
    frame = forecast.forecast_frame(series, values, ["series"])
    assert frame.where("forecast IS NOT NULL").agg(F.min("period"), F.max("period")).first() == (
        date(2019, 1, 1), date(2019, 12, 1))
    assert all(r.mape < 15 for r in forecast.forecast_accuracy(frame, ["series"]).collect())


def test_back_transform_restores_the_series(spark):
    series = spark.createDataFrame([("s", date(2020, m, 1), float(v)) for m, v in enumerate([3, 4, 9, 2, 8], 1)],
                                   "series string, period date, value double")
    steps = forecast.log_diff(series, ["series"]).where(F.month("period") > 2).select(
        "series", (F.month("period") - 2).alias("step"), F.col("y").alias("y_hat"))
    out = forecast.back_transform(steps, forecast.last_values(series, ["series"], "2020-02-01"), ["series"])
    assert [r.forecast for r in out.orderBy("step").collect()] == pytest.approx([9.0, 2.0, 8.0])


def test_seasonal_naive_repeats_over_a_long_horizon(spark):
    series = spark.createDataFrame([("s", date(2020, m, 1), m) for m in range(1, 13)], "series string, period date, value int")
    out = forecast.seasonal_naive(series, ["series"], "2020-12-01", 12, 18).orderBy("period").collect()
    assert [r.forecast for r in out] == [*range(1, 13), *range(1, 7)]
    assert out[-1].period == date(2022, 6, 1)


@pytest.fixture
def run_rows(spark, monkeypatch):
    """The main run over hand-made predictions: ordinary, an outlier, a small total, an unknown count, an expectation of 0."""
    cases = {"a": ((10, 20, 30), (20.0, 10.0, 30.0)), "b": ((1, 2, 10_001), (20.0, 10.0, 30.0)), "c": ((1, 2, 3), (1.0, 2.0, 6.0)),
             "d": ((None, 2, 3), (5.0, 5.0, 5.0)), "e": ((1, 2, 3), (0.1, 20.0, 5.0))}
    rows = [("S", f, f, date(2020, 1, 1), k, c, p) for f, (counts, preds) in cases.items() for k, c, p in zip(("ACCIDENT", "JAM", "WEATHERHAZARD"), counts, preds)]
    df = spark.createDataFrame(rows, "state string, county string, fips string, date date, alert_type string, count long, pred_count double")
    predictions = expected.model_features(df)
    monkeypatch.setattr(model_queries, "fitted", lambda *_: SimpleNamespace(predictions=predictions))


def test_the_main_run_has_index_outliers_and_suppression(spark, run_rows):
    out = {r.fips: r for r in model_queries.forest_index_rows(spark, "").collect()}
    assert {f for f, r in out.items() if r.is_outlier} == {"b"} and {f for f, r in out.items() if r.is_suppressed} == {"c"}
    assert {f for f, r in out.items() if r.impact_index_th is None} == {"b", "d", "e"}
    assert out["a"].impact_index_th == pytest.approx((-0.5 + 1 + 0) / 3) and out["b"].count_WEATHERHAZARD is None
    assert out["c"].pred_count_JAM is None and out["c"].pred_count_JAM_nf == 2 and out["e"].pred_count_ACCIDENT == 0


@pytest.mark.parametrize("step, wrong", [
    (None, None),
    ("null_outliers", lambda df: df),
    ("suppress_small_totals", lambda df, prefix: baseline.suppress_small_totals(df, prefix, 3)),
    ("impact_thresholded", lambda df: baseline.impact_thresholded(df).withColumn("impact_index_th", F.lit(0.0))),
    ("impact_thresholded", lambda df: baseline.impact_index(df, "_th")),
])
def test_forest_index_shows_an_error_in_any_step(spark, run_rows, monkeypatch, step, wrong):
    if step:
        monkeypatch.setattr(model_queries, "base", SimpleNamespace(**{**vars(baseline), step: wrong}))
    rows = model_queries.forest_index(spark, "").collect()
    assert len(rows) == 5 and all(r.has_predictions for r in rows) == (step is None)


def test_the_main_run_equals_sql(spark, run_rows):
    """Index, outliers and suppression, worked out by SQL from the same predictions."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pred (fips VARCHAR, kind VARCHAR, n BIGINT, p DOUBLE)")
    for r in model_queries.fitted(None, None).predictions.collect():
        con.execute("INSERT INTO pred VALUES (?, ?, ?, ?)", [r.fips, r.alert_type, r["count"], r.pred_count])
    least = {"ACCIDENT": 0.2, "JAM": 0.5, "WEATHERHAZARD": 0.5}
    kinds = list(least)
    cells = ", ".join(f"max(n) FILTER (WHERE kind = '{k}') AS n_{k}, max(p) FILTER (WHERE kind = '{k}') AS raw_{k}" for k in kinds)
    cut = ", ".join(f"CASE WHEN raw_{k} < {x} THEN 0 ELSE raw_{k} END AS p_{k}" for k, x in least.items())
    change = {k: f"(c_{k} - p_{k}) / nullif(p_{k}, 0)" for k in kinds}
    wanted = con.execute(f"""WITH wide AS (SELECT fips, {cells} FROM pred GROUP BY fips),
    clean AS (SELECT *, n_ACCIDENT AS c_ACCIDENT, n_JAM AS c_JAM, CASE WHEN n_WEATHERHAZARD <= 10000 THEN n_WEATHERHAZARD END AS c_WEATHERHAZARD, {cut} FROM wide),
    total AS (SELECT *, {' + '.join(f'p_{k}' for k in kinds)} AS total FROM clean)
    SELECT fips, c_WEATHERHAZARD, coalesce(n_WEATHERHAZARD > 10000, false), ({' + '.join(change.values())}) / 3, total, total < 10,
      {', '.join(f'CASE WHEN total >= 10 THEN p_{k} END' for k in kinds)} FROM total ORDER BY fips""").fetchall()
    columns = ["fips", "count_WEATHERHAZARD", "is_outlier", "impact_index_th", "pred_count_total", "is_suppressed", *[f"pred_count_{k}" for k in kinds]]
    found = [tuple(r) for r in model_queries.forest_index_rows(spark, "").select(*columns).orderBy("fips").collect()]
    assert [tuple(x if not isinstance(x, float) else pytest.approx(x) for x in w) for w in wanted] == found
