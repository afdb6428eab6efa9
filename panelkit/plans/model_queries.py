"""Queries on expected counts, scoring and forecasting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.constants import HORIZON, KINDS, LAGS, MIN_BASELINE, OUTLIER_CAP, SEASON, ZERO_BELOW
from panelkit.operators import baseline as base, expected as op, forecast as fc, scoring
from panelkit.operators.reshape import widen
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.baseline_queries import EXPECTED, expected
from panelkit.plans.panel_queries import full_panel
from panelkit.plans.registry import query
from panelkit.plans.sql import with_
from panelkit.session import shared_path, stage

BY = ["state", "alert_type"]


@query("model_features", with_(sql.PANEL, f"""SELECT fips, date, alert_type, count, {sql.month('date')} AS month,
  CAST(dayofweek(date) AS VARCHAR) AS dow, {sql.weekday('date')} AS day_week,
  CASE WHEN dayofweek(date) IN (0, 6) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weekend FROM panel"""))
def model_features(spark, d):
    return op.model_features(data.panel(spark, d)).select(
        "fips", "date", "alert_type", "count", "month", "dow", "day_week", "weekend"
    )


@query("split_train_test", """SELECT l_orderkey, l_linenumber, l_quantity,
  (l_orderkey * 7 + l_linenumber) % 10 < 3 AS is_test
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_shipdate IS NOT NULL""")
def split_train_test(spark, d):
    rows = data.table(spark, d, "lineitem")
    test = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 < 3
    split = op.split_train_test(rows, ["l_quantity", "l_shipdate"], test)
    return split.select("l_orderkey", "l_linenumber", "l_quantity", "is_test")


def _held_out(days: str, fips: str) -> str:
    """The rule by which rows of earlier years are held out, in both dialects."""
    return f"(({days}) * 7 + CAST({fips} AS INT) * 3) % 10 < 3"


def fitted(spark, d, **options) -> op.ExpectedFit:
    """Forests on the completed panel, so that true zeros train them too."""
    test = F.expr(_held_out("datediff(date, DATE'1992-01-01')", "fips"))
    return op.fit_expected(stage(full_panel(spark, d), "full-panel"), data.TARGET_YEAR, test=test, **options)


FITTED = f"""rows AS (SELECT *, year(date) = {data.TARGET_YEAR} AS is_target,
  {_held_out("date_diff('day', DATE '1992-01-01', date)", "fips")} AS is_test FROM full_panel WHERE year(date) <= {data.TARGET_YEAR}),
fits AS (SELECT state, alert_type, count(*) FILTER (WHERE NOT is_target AND count IS NOT NULL AND NOT is_test) AS n_fit,
  count(*) FILTER (WHERE NOT is_target AND count IS NOT NULL AND is_test) AS n_test, count(*) FILTER (WHERE is_target) AS n_predicted
  FROM rows GROUP BY ALL)"""


TRAINED = """trained AS (SELECT * FROM rows WHERE NOT is_target AND NOT is_test AND count IS NOT NULL),
ranges AS (SELECT state, alert_type, min(count) AS lowest, max(count) AS highest, count(DISTINCT fips) AS n_places FROM trained GROUP BY ALL)"""


@query("fit_expected", with_(sql.FULL, FITTED, TRAINED, """SELECT state, alert_type, n_predicted, 0::BIGINT AS n_unusable, lowest, highest,
  0::BIGINT AS n_outside, n_places, n_places AS n_near_mean FROM fits JOIN ranges USING (state, alert_type) WHERE n_predicted > 0"""))
def fit_expected(spark, d):
    """Rows that each model has predicted: how many are no count, or outside the counts that it was fitted to; and at
    how many of its places the mean prediction is nearer to their mean count than a quarter of it, or 45 % of what the
    places' means span. Where they span much, mixed up or constant predictions are not, at one end of it at least."""
    fit = fitted(spark, d)
    rows = stage(op.compile_predictions(fit.predictions), "compiled")
    train = stage(fit.complete.where("not is_test").groupBy(*BY, "fips").agg(
        F.avg("count").alias("mean"), F.min("count").alias("lowest"), F.max("count").alias("highest")), "trained")
    ranges = train.groupBy(*BY).agg(
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.count(F.lit(1)).alias("n_places"), (F.max("mean") - F.min("mean")).alias("span"))
    pred = F.col("pred_count")
    unusable = pred.isNull() | F.isnan(pred)
    outside = (pred < F.col("lowest") - 1e-9) | (pred > F.col("highest") + 1e-9)
    counted = rows.join(ranges, BY).groupBy(*BY, "lowest", "highest", "n_places").agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count_if(unusable).alias("n_unusable"), F.count_if(outside).alias("n_outside"))
    means = rows.groupBy(*BY, "fips").agg(F.avg("pred_count").alias("predicted")).join(train, [*BY, "fips"]).join(ranges.select(*BY, "span"), BY)
    allowed = F.greatest(0.45 * F.col("span"), 0.25 * F.col("mean"))
    near = F.abs(F.col("predicted") - F.col("mean")) <= allowed + 1e-9
    return counted.join(means.groupBy(*BY).agg(F.count_if(near).alias("n_near_mean")), BY)


@query("forest_metrics", with_(sql.FULL, FITTED, """SELECT state, alert_type, n_fit, n_test, state || '_' || alert_type AS model,
  true AS near_the_mean FROM fits WHERE n_fit > 0 AND n_test > 0"""))
def forest_metrics(spark, d):
    """Sizes, and whether the error on held-out rows exceeds that of their mean by a tenth at most."""
    fit = fitted(spark, d)
    plain = fit.holdout.groupBy("state", "alert_type").agg(F.var_pop("count").alias("variance"))
    metrics = op.model_metrics(fit).join(plain, ["state", "alert_type"])
    return metrics.select("state", "alert_type", "n_fit", "n_test", "model", (F.col("mse") <= 1.1 * F.col("variance") + 1e-9).alias("near_the_mean"))


def main_run(spark, d) -> DataFrame:
    """Panel, forest, outliers, thresholds, index and suppression, a row per place and day.

    ``observed_WEATHERHAZARD`` is the count before the outlier rule; ``is_outlier``
    and ``is_suppressed`` mark the rows that the rules have changed.
    """
    rows = op.compile_predictions(fitted(spark, d).predictions)
    wide = base.observed_vs_predicted_wide(rows, ["state", "county", "fips", "date"])
    kept = wide.withColumn("observed_WEATHERHAZARD", F.col("count_WEATHERHAZARD"))
    clean = base.impact_thresholded(base.null_outliers(kept))
    cleaned = base.suppress_small_totals(clean, "pred_count")
    return cleaned.withColumns({
        "is_outlier": F.col("observed_WEATHERHAZARD").isNotNull() & F.col("count_WEATHERHAZARD").isNull(),
        "is_suppressed": F.col("pred_count_total").isNotNull() & F.col("pred_count_JAM").isNull(),
    })


def run_holds(rows: DataFrame) -> DataFrame:
    """The rows of ``main_run`` with ``holds``: whether each column follows from those that it is made of."""
    counts, before, after = ([F.col(f"{p}_{k}{s}") for k in KINDS] for p, s in (("count", ""), ("pred_count", "_nf"), ("pred_count", "")))
    both = lambda parts: reduce(lambda a, b: a & b, parts)
    near = lambda a, b: F.abs(a - b) <= 1e-9 * (1 + F.abs(b))
    seen, small, index = F.col("observed_WEATHERHAZARD"), sum(before) < MIN_BASELINE, F.col("impact_index_th")
    defined = both(c.isNotNull() & p.isNotNull() & (p != 0) for c, p in zip(counts, before))
    mean = sum(c / F.nullif(p, F.lit(0)) - 1 for c, p in zip(counts, before)) / len(KINDS)
    parts = [
        *[(p == 0) | (p >= ZERO_BELOW[k]) for k, p in zip(KINDS, before)],
        F.col("count_WEATHERHAZARD").eqNullSafe(F.when(seen <= OUTLIER_CAP, seen)),
        F.col("is_outlier").eqNullSafe(F.coalesce(seen > OUTLIER_CAP, F.lit(False))),
        index.isNotNull() == defined, F.coalesce(near(index, mean), ~defined),
        near(F.col("pred_count_total"), sum(before)), F.col("is_suppressed").eqNullSafe(small),
        *[b.eqNullSafe(F.when(~small, p)) for p, b in zip(before, after)],
    ]
    return rows.withColumn("holds", F.coalesce(both(parts), F.lit(False)))


@query("forest_index", with_(sql.FULL, FITTED, f"""SELECT f.state, f.county, f.fips, f.date, true AS has_predictions
  FROM rows f WHERE is_target GROUP BY ALL"""))
def forest_index(spark, d):
    """Whether the main run has predictions for each place and day, and its index, outlier and suppression columns follow from them."""
    return run_holds(main_run(spark, d)).select("state", "county", "fips", "date", F.col("holds").alias("has_predictions"))


@query("forest_index_rows")
def forest_index_rows(spark, d):
    """All columns of the main run. SQL can't fit a forest; ``forest_index`` states what SQL can check of them."""
    return main_run(spark, d)


METRICS = """metrics AS (SELECT state, alert_type, count(*) AS n_test,
  avg((count - pred_count) * (count - pred_count)) AS mse, state || '_' || alert_type AS model
  FROM expected WHERE pred_count IS NOT NULL GROUP BY ALL)"""


def metrics(spark, d) -> DataFrame:
    return op.fit_metrics(expected(spark, d))


@query("fit_metrics", with_(sql.PANEL, EXPECTED, METRICS, "SELECT * REPLACE (round(mse, 6) AS mse) FROM metrics"))
def fit_metrics(spark, d):
    return data.shown(metrics(spark, d), "mse")


@query("flag_models", with_(sql.PANEL, EXPECTED, METRICS,
       "limits AS (SELECT quantile_cont(mse, 0.8) AS high, quantile_cont(mse, 0.1) AS low FROM metrics)",
       """SELECT state, alert_type, n_test, round(mse, 6) AS mse, model,
  CASE WHEN mse > high THEN 'high' WHEN mse < low THEN 'low' END AS flag
  FROM metrics CROSS JOIN limits WHERE mse > high OR mse < low"""))
def flag_models(spark, d):
    return data.shown(op.flag_models(stage(metrics(spark, d), "metrics")), "mse")


@query("compile_predictions", with_(sql.PANEL, EXPECTED, f"""SELECT date, state, county, alert_type, count, pred_count, fips,
  {sql.year('date')} AS year, {sql.month('date')} AS month, {sql.dow('date')} AS dow, {sql.weekday('date')} AS day_week,
  dayofweek(date) IN (0, 6) AS weekend, {sql.block_week('date')} AS week_year FROM expected"""))
def compile_predictions(spark, d):
    return op.compile_predictions(expected(spark, d))


SCORED = """scored AS (SELECT doc_id, quality AS obs,
  CAST(n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents JOIN labels USING (doc_id)) AS score
  FROM labels JOIN documents USING (doc_id))"""


def labelled(spark, d) -> DataFrame:
    return data.table(spark, d, "labels").join(data.table(spark, d, "documents"), "doc_id")


def scored(spark, d) -> DataFrame:
    rows = labelled(spark, d)
    longest = rows.agg(F.max("n_chars")).scalar()
    return rows.select("doc_id", F.col("quality").alias("obs"), (F.col("n_chars") / longest).alias("score"))


@query("classify", with_(SCORED, """SELECT *, CAST(score > 0.2 AS INTEGER) AS pred, obs <> 1 AND score <= 0.2 AS tn,
  obs <> 1 AND score > 0.2 AS fp, obs = 1 AND score <= 0.2 AS fn, obs = 1 AND score > 0.2 AS tp FROM scored"""))
def classify(spark, d):
    return scoring.classify(scored(spark, d), "obs", "score")


@query("classification_report", with_(SCORED, "ranked AS (SELECT obs, rank() OVER (ORDER BY score) "
       "+ (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)",
       "area AS (SELECT (sum(r) FILTER (WHERE obs = 1) - count(*) FILTER (WHERE obs = 1) * (count(*) FILTER (WHERE obs = 1) + 1) / 2.0)"
       " / (CAST(count(*) FILTER (WHERE obs = 1) AS DOUBLE) * count(*) FILTER (WHERE obs = 0)) AS auc FROM ranked)",
       """SELECT count(*) AS n, count(*) FILTER (WHERE obs = 1 AND score > 0.2) AS tp,
  count(*) FILTER (WHERE obs = 0 AND score > 0.2) AS fp, count(*) FILTER (WHERE obs = 0 AND score <= 0.2) AS tn,
  count(*) FILTER (WHERE obs = 1 AND score <= 0.2) AS fn, round(avg((obs - score) * (obs - score)), 6) AS mse,
  round(any_value(auc), 6) AS auc FROM scored CROSS JOIN area"""))
def classification_report(spark, d):
    return data.shown(scoring.classification_report(scored(spark, d), "obs", "score"), "mse", "auc")


@query("rescore", """SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_yes, count(*) AS n_equal, true AS area_known
  FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 < 3 AND quality IS NOT NULL""")
def rescore(spark, d):
    """Fit a classification forest on part of the labels, save it, and rescore the rest: with the scores of the model as it was before."""
    rows = stage(labelled(spark, d).select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        F.col("quality").cast("double").alias("obs"), (F.col("doc_id") % 10 < 3).alias("is_test"),
    ).dropna(), "labelled")
    path, test = shared_path(spark, "model"), rows.where("is_test")
    model = scoring.fit_classes(rows.where("not is_test"), "obs", ["lang"], ["n_chars", "n_words"])
    model.write().save(path)
    before = scoring.votes_of(model.transform(test), ["no", "before"]).select("doc_id", "votes_before")
    scored = stage(scoring.rescore(path, test).join(before, "doc_id"), "rescored")
    equal = scored.agg(F.count_if(F.abs(F.col("score") - F.col("votes_before")) <= 1e-12)).scalar()
    report = scoring.classification_report(scored, "obs", "score")
    known = (F.col("auc").isNull() & ((F.col("tp") + F.col("fn") == 0) | (F.col("fp") + F.col("tn") == 0))) | F.col("auc").between(0, 1)
    return report.select("n", (F.col("tp") + F.col("fn")).alias("n_yes"), equal.alias("n_equal"), known.alias("area_known"))


END = "2000-12-31"

SERIES = f"""{sql.PANEL},
series AS (SELECT state, alert_type, date_trunc('month', date)::DATE AS period, CAST(sum(count) AS BIGINT) AS value
  FROM panel WHERE last_day(date) <= (SELECT max(date) FROM panel) GROUP BY ALL)"""


@query("long_series", with_(SERIES, """SELECT state, alert_type, period, value FROM series WHERE period <= DATE '2000-12-01'"""))
def long_series(spark, d):
    series = data.monthly_series(spark, d)
    wide = widen(
        series.withColumns({"Year": F.year("period"), "month": F.date_format("period", "MMM")}),
        [*BY, "Year"], "month", {"m": "value"}, data.MONTHS,
    ).withColumnsRenamed({f"m_{m}": m for m in data.MONTHS})
    return fc.long_series(wide, BY, "Year", data.MONTHS, "2000-12-01")


@query("holdout_window", with_(SERIES, f"SELECT *, period <= DATE '{END}' AS is_train FROM series"))
def holdout_window(spark, d):
    return fc.holdout_window(data.monthly_series(spark, d), END)


def _diffed(lag: int, name: str = "diffed") -> str:
    return f"""logged AS (SELECT s.*, ln(s.value) - ln(b.value) AS y FROM series s LEFT JOIN series b
  ON b.state = s.state AND b.alert_type = s.alert_type AND b.period = s.period - to_months({lag})),
{name} AS (SELECT * FROM logged WHERE y IS NOT NULL)"""


@query("log_diff", with_(SERIES, _diffed(1), "SELECT * REPLACE (round(y, 6) AS y) FROM diffed"))
def log_diff(spark, d):
    return data.shown(fc.log_diff(data.monthly_series(spark, d), BY), "y")


@query("log_diff_seasonal", with_(SERIES, _diffed(12), "SELECT * REPLACE (round(y, 6) AS y) FROM diffed"))
def log_diff_seasonal(spark, d):
    return data.shown(fc.log_diff(data.monthly_series(spark, d), BY, SEASON), "y")


LAG_NAMES = [f"lag{i}" for i in range(1, LAGS + 1)]


@query("lag_embed", with_(SERIES, _diffed(1), "lagged AS (SELECT d.*, " + ", ".join(f"d{i}.y AS lag{i}" for i in range(1, LAGS + 1)) + " FROM diffed d "
       + " ".join(f"LEFT JOIN diffed d{i} ON d{i}.state = d.state AND d{i}.alert_type = d.alert_type AND d{i}.period = d.period - to_months({i})"
                  for i in range(1, LAGS + 1)) + ")", "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in ["y", *LAG_NAMES])
       + ") FROM lagged WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in LAG_NAMES)))
def lag_embed(spark, d):
    embedded = fc.lag_embed(fc.log_diff(data.monthly_series(spark, d), BY), BY)
    return data.shown(embedded, "y", *LAG_NAMES)


def forecasts(spark, d) -> tuple[DataFrame, DataFrame]:
    series = stage(data.monthly_series(spark, d), "series")
    return series, stage(fc.direct_forecast(fc.log_diff(series, BY), BY, END), "forecasts")


# Series whose last training month has a value for each of the months that the model looks back to.
FORECAST = _diffed(1) + f""",
ends AS (SELECT state, alert_type, max(period) AS period FROM diffed WHERE period <= DATE '{END}' GROUP BY ALL),
able AS (SELECT e.state, e.alert_type, e.period FROM ends e JOIN diffed d ON d.state = e.state AND d.alert_type = e.alert_type
  AND d.period BETWEEN e.period - to_months({LAGS - 1}) AND e.period GROUP BY ALL HAVING count(*) = {LAGS})"""


@query("direct_forecast", with_(SERIES, FORECAST, f"""SELECT state, alert_type, CAST(unnest(range(1, {HORIZON} + 1)) AS INTEGER) AS step,
  round((SELECT min(y) FROM diffed WHERE period <= DATE '{END}'), 6) AS lowest, round((SELECT max(y) FROM diffed WHERE period <= DATE '{END}'), 6) AS highest,
  true AS inside FROM able"""))
def direct_forecast(spark, d):
    """Whether each forecast lies between the smallest and the largest value that the forests were fitted to."""
    series, steps = forecasts(spark, d)
    known = fc.log_diff(series, BY).where(F.col("period") <= F.lit(END).cast("date"))
    span = known.agg(F.struct(F.min("y").alias("lowest"), F.max("y").alias("highest"))).scalar()
    inside = F.col("y_hat").between(F.col("span.lowest") - 1e-9, F.col("span.highest") + 1e-9)
    placed = steps.withColumn("span", span)
    return data.shown(placed.select(*BY, "step", "span.lowest", "span.highest", F.coalesce(inside, F.lit(False)).alias("inside")), "lowest", "highest")


@query("forest_forecast_accuracy", with_(SERIES, FORECAST, f"""SELECT a.state, a.alert_type, count(*) AS n_months, round(avg(s.value), 6) AS mean_value, true AS finite FROM able a
  JOIN (SELECT state, alert_type, max(period) AS last FROM series WHERE period <= DATE '{END}' GROUP BY ALL) l
  ON l.state = a.state AND l.alert_type = a.alert_type
  JOIN series s ON s.state = a.state AND s.alert_type = a.alert_type AND s.period > l.last AND s.period <= l.last + to_months({HORIZON})
  GROUP BY ALL"""))
def forest_forecast_accuracy(spark, d):
    """Months that a forecast covers, their mean, and whether the error measures agree with one another and with it."""
    series, steps = forecasts(spark, d)
    values = fc.back_transform(steps, fc.last_values(series, BY, END), BY)
    frame = stage(fc.forecast_frame(series, values, BY), "frame")
    covered = frame.where("forecast IS NOT NULL").groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("value").alias("mean_value"), F.avg("forecast").alias("mean_forecast"))
    accuracy = fc.forecast_accuracy(frame, BY).join(covered, BY)
    difference = F.col("mean_value") - F.col("mean_forecast")
    agree = (F.col("rmse") >= F.col("mae") - 1e-6) & (F.col("mae") >= F.abs("me") - 1e-6) & (F.abs(F.col("me") - difference) <= 1e-6 * (1 + F.abs(difference)))
    return data.shown(accuracy.select(*BY, "n_months", "mean_value", F.coalesce(agree, F.lit(False)).alias("finite")), "mean_value")


# Last year's log differences, as a forecast that SQL can follow.
REPEATED = f"""{_diffed(1)},
steps AS (SELECT state, alert_type, CAST(month(period) AS INTEGER) AS step, y AS y_hat FROM diffed WHERE year(period) = 2000),
last AS (SELECT state, alert_type, value AS last_value FROM series WHERE period = DATE '2000-12-01'),
forecasts AS (SELECT s.state, s.alert_type, step, (DATE '2000-12-01' + to_months(step))::DATE AS period,
  last_value * exp(sum(y_hat) OVER (PARTITION BY s.state, s.alert_type ORDER BY step)) AS forecast
  FROM steps s JOIN last l ON l.state = s.state AND l.alert_type = s.alert_type)"""


def repeated(spark, d) -> tuple[DataFrame, DataFrame]:
    series = stage(data.monthly_series(spark, d), "series")
    steps = fc.log_diff(series, BY).where(F.year("period") == 2000).select(
        *BY, F.month("period").alias("step"), F.col("y").alias("y_hat")
    )
    return series, fc.back_transform(steps, fc.last_values(series, BY, END), BY)


@query("back_transform", with_(SERIES, REPEATED, "SELECT * REPLACE (round(forecast, 6) AS forecast) FROM forecasts"))
def back_transform(spark, d):
    return data.shown(repeated(spark, d)[1], "forecast")


@query("forecast_frame", with_(SERIES, REPEATED, """SELECT s.*, round(f.forecast, 6) AS forecast FROM series s
  LEFT JOIN forecasts f ON f.state = s.state AND f.alert_type = s.alert_type AND f.period = s.period"""))
def forecast_frame(spark, d):
    series, values = repeated(spark, d)
    return data.shown(fc.forecast_frame(series, values, BY), "forecast")


NAIVE = f"""naive AS (SELECT state, alert_type, (period + to_months({SEASON}))::DATE AS period, value AS forecast
  FROM series WHERE period BETWEEN DATE '2000-01-01' AND DATE '2000-12-01')"""


@query("seasonal_naive", with_(SERIES, NAIVE, "SELECT * FROM naive"))
def seasonal_naive(spark, d):
    return fc.seasonal_naive(data.monthly_series(spark, d), BY, "2000-12-01", SEASON, HORIZON)


@query("forecast_accuracy", with_(SERIES, NAIVE, """SELECT s.state, s.alert_type, round(avg(value - forecast), 6) AS me,
  round(sqrt(avg((value - forecast) * (value - forecast))), 6) AS rmse, round(avg(abs(value - forecast)), 6) AS mae,
  round(avg(100 * (value - forecast) / nullif(value, 0)), 6) AS mpe,
  round(avg(abs(100 * (value - forecast) / nullif(value, 0))), 6) AS mape
  FROM series s JOIN naive n ON n.state = s.state AND n.alert_type = s.alert_type AND n.period = s.period GROUP BY ALL"""))
def forecast_accuracy(spark, d):
    series = stage(data.monthly_series(spark, d), "series")
    naive = fc.seasonal_naive(series, BY, "2000-12-01")
    accuracy = fc.forecast_accuracy(fc.forecast_frame(series, naive, BY), BY)
    return data.shown(accuracy, "me", "rmse", "mae", "mpe", "mape")


