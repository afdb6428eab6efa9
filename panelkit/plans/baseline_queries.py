"""Queries on baselines, impact indices and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelkit.constants import KINDS, ZERO_BELOW
from panelkit.operators import baseline as op
from panelkit.operators.expected import baseline_mean_expected
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.panel_queries import full_panel
from panelkit.plans.registry import query
from panelkit.plans.sql import with_

YEAR = data.TARGET_YEAR
WINDOW_SQL = f"DATE '{data.WINDOW[0]}' AND DATE '{data.WINDOW[1]}'"


def _statistics(prefix: str) -> str:
    return f"""{sql.rounded('avg(count)', 1)} AS {prefix}_mean, {sql.rounded('median(count)', 1)} AS {prefix}_median,
  {sql.rounded('stddev_samp(count)', 1)} AS {prefix}_sd, count(*) AS {prefix}_n"""


def _hist(source: str) -> str:
    return f"""hist AS (SELECT alert_type, fips, state, county, {sql.month('date')} AS month,
  {sql.weekday('date')} AS day_week, {_statistics('hist')}
  FROM {source} WHERE year(date) < {YEAR} GROUP BY ALL)"""


def _bl(source: str) -> str:
    return f"""bl AS (SELECT alert_type, fips, state, county, {sql.weekday('date')} AS day_week, {_statistics('bl')}
  FROM {source} WHERE date BETWEEN {WINDOW_SQL} GROUP BY ALL)"""


@query("historical_profile", with_(sql.PANEL, _hist("panel"), "SELECT * FROM hist"))
def historical_profile(spark, d):
    return op.historical_profile(data.panel(spark, d), YEAR)


@query("historical_profile_complete", with_(sql.FULL, _hist("full_panel"), "SELECT * FROM hist"))
def historical_profile_complete(spark, d):
    return op.historical_profile(full_panel(spark, d), YEAR)


@query("window_baseline", with_(sql.PANEL, _bl("panel"), "SELECT * FROM bl"))
def window_baseline(spark, d):
    return op.window_baseline(data.panel(spark, d), *data.WINDOW)


@query("baseline_rollups", with_(sql.PANEL, _bl("panel"), f"""SELECT alert_type, fips, state, county,
  CASE WHEN grouping(alert_type) = 0 AND grouping(fips) = 0 THEN 'place and kind'
    WHEN grouping(alert_type) = 0 THEN 'state and kind' WHEN grouping(fips) = 0 THEN 'place' ELSE 'state' END AS grain,
  {sql.rounded('coalesce(sum(bl_mean), 0)', 1)} AS bl_sum, count(*) AS bl_n
  FROM bl GROUP BY GROUPING SETS ((alert_type, fips, state, county), (alert_type, state), (fips, state, county), (state))"""))
def baseline_rollups(spark, d):
    return op.baseline_rollups(op.window_baseline(data.panel(spark, d), *data.WINDOW))


EXPECTED = f"""{_bl('panel')},
expected AS (SELECT p.*, b.bl_mean AS pred_count FROM panel p
  LEFT JOIN bl b ON b.alert_type = p.alert_type AND b.fips = p.fips AND b.day_week = {sql.weekday('p.date')}
  WHERE year(p.date) = {YEAR})"""


def expected(spark, d, panel: DataFrame | None = None) -> DataFrame:
    panel = data.panel(spark, d) if panel is None else panel
    return baseline_mean_expected(panel, YEAR, *data.WINDOW)


@query("baseline_mean_expected", with_(sql.PANEL, EXPECTED, "SELECT * FROM expected"))
def mean_expected(spark, d):
    return expected(spark, d)


PLACE_DAY = ["fips", "state", "county", "date"]

WIDE = f"""{EXPECTED},
wide AS (SELECT fips, state, county, date, {sql.each("max(count) FILTER (WHERE alert_type = '{k}') AS count_{k}")},
  {sql.each("max(pred_count) FILTER (WHERE alert_type = '{k}') AS pred_count_{k}")} FROM expected GROUP BY ALL)"""


def wide(spark, d, panel: DataFrame | None = None) -> DataFrame:
    return op.observed_vs_predicted_wide(expected(spark, d, panel), PLACE_DAY)


@query("observed_vs_predicted_wide", with_(sql.PANEL, WIDE, "SELECT * FROM wide"))
def observed_vs_predicted_wide(spark, d):
    return wide(spark, d)


def _impact(suffix: str = "", predicted: str = "pred_count_{k}", source: str = "wide", name: str = "impact") -> str:
    changes = ", ".join(
        f"{sql.change(f'count_{k}', predicted.replace('{k}', k))} AS {op.IMPACT_NAMES[k]}{suffix}" for k in KINDS
    )
    total = " + ".join(f"{op.IMPACT_NAMES[k]}{suffix}" for k in KINDS)
    return f"""{name}_parts AS (SELECT *, {changes} FROM {source}),
{name} AS (SELECT *, ({total}) / 3 AS impact_index{suffix} FROM {name}_parts)"""


@query("impact_index", with_(sql.PANEL, WIDE, _impact(), "SELECT * FROM impact"))
def impact_index(spark, d):
    return op.impact_index(wide(spark, d))


def _spread(prefix: str, keys: str, source: str) -> str:
    cells = ", ".join(
        sql.each(f"max({prefix}_{m}) FILTER (WHERE alert_type = '{{k}}') AS {prefix}_{m}_{{k}}")
        for m in ("mean", "median", "sd", "n")
    )
    return f"{source}_wide AS (SELECT {keys}, {cells} FROM {source} GROUP BY ALL)"


INDICES = f"""{WIDE},\n{_impact()},\n{_hist('panel')},
{_spread('hist', 'fips, state, county, month, day_week', 'hist')},
{_spread('bl', 'fips, state, county, day_week', 'bl')},
keyed AS (SELECT *, {sql.month('date')} AS month, {sql.weekday('date')} AS day_week FROM impact),
indices AS (SELECT k.*, h.* EXCLUDE (fips, state, county, month, day_week), b.* EXCLUDE (fips, state, county, day_week)
  FROM keyed k
  LEFT JOIN hist_wide h ON h.fips = k.fips AND h.state = k.state AND h.county = k.county
    AND h.month = k.month AND h.day_week = k.day_week
  LEFT JOIN bl_wide b ON b.fips = k.fips AND b.state = k.state AND b.county = k.county AND b.day_week = k.day_week)"""


def indices(spark, d) -> DataFrame:
    """The index table of the target year with both baselines attached."""
    panel = data.staged_panel(spark, d)
    return op.join_baselines(
        op.impact_index(wide(spark, d, panel)),
        op.historical_profile(panel, YEAR),
        op.window_baseline(panel, *data.WINDOW),
    )


@query("join_baselines", with_(sql.PANEL, INDICES, "SELECT * FROM indices"))
def join_baselines(spark, d):
    return indices(spark, d)


@query("null_outliers", with_(sql.PANEL, WIDE, f"""SELECT * REPLACE (
  CASE WHEN count_WEATHERHAZARD > {data.HIGH_COUNT} THEN NULL ELSE count_WEATHERHAZARD END AS count_WEATHERHAZARD) FROM wide"""))
def null_outliers(spark, d):
    return op.null_outliers(wide(spark, d), cap=data.HIGH_COUNT)


# Counts of the test tables are larger than those the thresholds are meant for.
ZERO_BELOW_HERE = {k: t * 100 for k, t in ZERO_BELOW.items()}

THRESHOLDED = "thresholded AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN pred_count_{k} < {t} THEN 0.0::DOUBLE ELSE pred_count_{k} END AS pred_count_{k}"
    for k, t in ZERO_BELOW_HERE.items()
) + ") FROM wide)"


@query("threshold_predictions", with_(sql.PANEL, WIDE, THRESHOLDED, "SELECT * FROM thresholded"))
def threshold_predictions(spark, d):
    return op.threshold_predictions(wide(spark, d), ZERO_BELOW_HERE)


@query("impact_thresholded", with_(sql.PANEL, WIDE, THRESHOLDED,
       _impact("_th", source="thresholded"), "SELECT * FROM impact"))
def impact_thresholded(spark, d):
    return op.impact_thresholded(wide(spark, d), ZERO_BELOW_HERE)


@query("impact_rounded", with_(sql.PANEL, WIDE, _impact("_rnd", sql.rounded("pred_count_{k}", 0)), "SELECT * FROM impact"))
def impact_rounded(spark, d):
    return op.impact_rounded(wide(spark, d))


# Small enough to suppress some totals of the test tables and keep others.
MIN_TOTAL = 85


def _suppressed(prefix: str, least, source: str) -> str:
    total = " + ".join(f"{prefix}_{k}" for k in KINDS)
    small = f"coalesce({total} < {least}, false)"
    cells = sql.each(f"CASE WHEN NOT {small} THEN {prefix}_{{k}} END AS {prefix}_{{k}}")
    return f"""SELECT * REPLACE ({cells}), {sql.each(f'{prefix}_{{k}} AS {prefix}_{{k}}_nf')},
  {total} AS {prefix}_total FROM {source}"""


@query("suppress_small_totals", with_(sql.PANEL, WIDE, _suppressed("pred_count", MIN_TOTAL, "wide")))
def suppress_small_totals(spark, d):
    return op.suppress_small_totals(wide(spark, d), "pred_count", MIN_TOTAL)


@query("suppress_small_baseline_totals", with_(sql.PANEL, _bl("panel"),
       _spread("bl", "fips, state, county, day_week", "bl"),
       _suppressed("bl_mean", MIN_TOTAL, f"(SELECT fips, state, county, day_week, {sql.each('bl_mean_{k}')} FROM bl_wide)")))
def suppress_small_baseline_totals(spark, d):
    means = op.widen(
        op.window_baseline(data.panel(spark, d), *data.WINDOW), [*op.PLACE, "day_week"],
        "alert_type", {"bl_mean": "bl_mean"}, KINDS,
    )
    return op.suppress_small_totals(means, "bl_mean", MIN_TOTAL)


@query("sufficient_rows", with_(sql.PANEL, WIDE, f"""SELECT state, count(*) AS n_rows,
  count(*) - count(*) FILTER (WHERE {' + '.join(f'pred_count_{k}' for k in KINDS)} < {MIN_TOTAL}) AS n_sufficient
  FROM wide GROUP BY state"""))
def sufficient_rows(spark, d):
    kept = op.suppress_small_totals(wide(spark, d), "pred_count", MIN_TOTAL)
    return op.sufficient_rows(kept, ["state"], "pred_count_total", MIN_TOTAL)


@query("suppress_small_cells", with_(sql.PANEL, WIDE, f"""SELECT * REPLACE (
  {sql.each('CASE WHEN pred_count_{k} >= 25 THEN pred_count_{k} END AS pred_count_{k}')}) FROM wide"""))
def suppress_small_cells(spark, d):
    return op.suppress_small_cells(wide(spark, d), [f"pred_count_{k}" for k in KINDS], 25)


@query("high_value_rows", with_(sql.PANEL, INDICES, """SELECT fips, date, pred_count_JAM, hist_mean_JAM
  FROM indices WHERE pred_count_JAM > 35 AND hist_mean_JAM < 35"""))
def high_value_rows(spark, d):
    rows = op.high_value_rows(indices(spark, d), "pred_count_JAM", 35, ("hist_mean_JAM", 35))
    return rows.select("fips", "date", "pred_count_JAM", "hist_mean_JAM")


@query("state_day_summary", with_(sql.PANEL, sql.CASES, WIDE, _impact(), """SELECT i.date, state,
  CAST(coalesce(sum(cases), 0) AS BIGINT) AS sum_cases, CAST(coalesce(sum(deaths), 0) AS BIGINT) AS sum_deaths,
  median(impact_index) AS median_impact_index
  FROM impact i LEFT JOIN cases c ON c.fips = i.fips AND c.date = i.date GROUP BY ALL"""))
def state_day_summary(spark, d):
    with_cases = op.impact_index(wide(spark, d)).join(data.cases(spark, d), ["fips", "date"], "left")
    return op.state_day_summary(with_cases)


# Every step above in order: thresholds, index, suppression of both baselines.
@query("cleaned_index", with_(sql.PANEL, INDICES.replace("indices AS", "joined AS"),
       "thresholded AS (SELECT * REPLACE (" + ", ".join(
           f"CASE WHEN pred_count_{k} < {t} THEN 0.0::DOUBLE ELSE pred_count_{k} END AS pred_count_{k}"
           for k, t in ZERO_BELOW_HERE.items()) + f""",
  CASE WHEN count_WEATHERHAZARD > {data.HIGH_COUNT} THEN NULL ELSE count_WEATHERHAZARD END AS count_WEATHERHAZARD) FROM joined)""",
       _impact("_th", source="thresholded", name="clean"),
       "suppressed AS (" + _suppressed("pred_count", MIN_TOTAL, "clean") + ")",
       _suppressed("bl_mean", MIN_TOTAL, "suppressed")))
def cleaned_index(spark, d):
    clean = op.impact_thresholded(op.null_outliers(indices(spark, d), cap=data.HIGH_COUNT), ZERO_BELOW_HERE)
    return op.suppress_small_totals(
        op.suppress_small_totals(clean, "pred_count", MIN_TOTAL), "bl_mean", MIN_TOTAL
    )


