"""Queries on patching and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.constants import KINDS
from panelkit.functions import dates
from panelkit.operators import baseline, keys, patch, quality as op
from panelkit.operators.compare import SHORT
from panelkit.operators.panel import daily_match_panel, weekly_panel
from panelkit.operators.reshape import widen
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.baseline_queries import EXPECTED, expected
from panelkit.plans.panel_queries import COUNTY, full_panel
from panelkit.plans.registry import query
from panelkit.plans.sql import with_

SUBSTITUTES = [f"substitute_{k}" for k in KINDS]
STATES_SQL = ", ".join(f"'{s}'" for s in data.PATCH_STATES)
CHOSEN = f"""chosen AS (SELECT *, {sql.month('date')} AS month, {sql.dow('date')} AS dow, {sql.block_week('date')} AS week
  FROM panel WHERE year(date) = {data.PATCH_YEAR} AND month(date) IN (5, 6) AND state IN ({STATES_SQL}))"""


def _wide(keys_: str, source: str) -> str:
    cells = sql.each("max(value) FILTER (WHERE alert_type = '{k}' AND value >= 10) AS substitute_{k}")
    return f"SELECT {keys_}, {cells} FROM {source} GROUP BY ALL"


SUB_STATE = f"""{CHOSEN},
means AS (SELECT fips, alert_type, state, month, dow, avg(count) AS mean FROM chosen GROUP BY ALL),
by_state AS (SELECT alert_type, state, month, dow, coalesce(sum(mean), 0) AS value FROM means GROUP BY ALL),
sub_state AS ({_wide('state, month, dow', 'by_state')})"""
SUB_COUNTY = f"""{CHOSEN},
by_county AS (SELECT fips, alert_type, state, month, dow, avg(count) AS value FROM chosen GROUP BY ALL),
sub_county AS ({_wide('fips, state, month, dow', 'by_county')})"""
SUB_WEEK = f"""{CHOSEN},
by_week AS (SELECT fips, alert_type, state, week, CAST(coalesce(sum(count), 0) AS BIGINT) AS value FROM chosen GROUP BY ALL),
sub_week AS ({_wide('fips, state, week', 'by_week')})"""
PATCHED = (data.PATCH_YEAR, data.PATCH_MONTHS, data.PATCH_STATES)


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("substitute_profile_state", with_(sql.PANEL, SUB_STATE,
       f"SELECT * REPLACE ({_rounded(SUBSTITUTES)}) FROM sub_state"))
def substitute_profile_state(spark, d):
    return data.shown(patch.substitute_profile_state(data.panel(spark, d), *PATCHED), *SUBSTITUTES)


@query("substitute_profile_county", with_(sql.PANEL, SUB_COUNTY, "SELECT * FROM sub_county"))
def substitute_profile_county(spark, d):
    return patch.substitute_profile_county(data.panel(spark, d), *PATCHED)


@query("substitute_week_sums", with_(sql.PANEL, SUB_WEEK, "SELECT * FROM sub_week"))
def substitute_week_sums(spark, d):
    return patch.substitute_week_sums(data.panel(spark, d), *PATCHED)


MEANS = [f"prior_mean_{k}" for k in KINDS]


def _patched(prefix: str, source: str, patch_: str, on: list[str]) -> str:
    cells = sql.each(
        f"CASE WHEN t.state IN ({STATES_SQL}) THEN coalesce(s.substitute_{{k}}, t.{prefix}_{{k}})"
        f" ELSE t.{prefix}_{{k}} END AS {prefix}_{{k}}"
    )
    match = " AND ".join(f"t.{c} = s.{c}" for c in on)
    return f"SELECT t.* REPLACE ({cells}) FROM {source} t LEFT JOIN {patch_} s ON {match}"


STATE_DAY = f"""{sql.match(['state'], source='state_days')}""".replace(
    "wide AS", "state_days AS (SELECT state, date, alert_type, sum(count)::BIGINT AS count FROM panel GROUP BY ALL),\nwide AS", 1
)


def state_days(panel: DataFrame) -> DataFrame:
    by_state = panel.groupBy("state", "date", "alert_type").agg(F.sum("count").alias("count"))
    return daily_match_panel(by_state, ["state"])


@query("apply_patch_state_day", with_(sql.PANEL, SUB_STATE, STATE_DAY.replace("means AS", "prior AS").replace(
       "LEFT JOIN means", "LEFT JOIN prior"), "patched AS (" + _patched("prior_mean", "matched", "sub_state", ["state", "month", "dow"]) + ")",
       f"SELECT * REPLACE ({_rounded(MEANS)}) FROM patched"))
def apply_patch_state_day(spark, d):
    panel = data.staged_panel(spark, d)
    substitute = patch.substitute_profile_state(panel, *PATCHED)
    patched = patch.apply_patch(
        state_days(panel), substitute, ["state", "month", "dow"], data.PATCH_STATES, "prior_mean"
    )
    return data.shown(patched, *MEANS)


@query("apply_patch_metro_day", with_(sql.PANEL, SUB_COUNTY, sql.match(COUNTY),
       _patched("prior_mean", "matched", "sub_county", ["fips", "state", "month", "dow"])))
def apply_patch_metro_day(spark, d):
    panel = data.staged_panel(spark, d)
    return patch.apply_patch(
        daily_match_panel(panel, COUNTY), patch.substitute_profile_county(panel, *PATCHED),
        ["fips", "state", "month", "dow"], data.PATCH_STATES, "prior_mean",
    )


@query("apply_patch_metro_week", with_(sql.PANEL, SUB_WEEK, sql.weeks(COUNTY),
       _patched("prior_year", "weekly", "sub_week", ["fips", "state", "week"])))
def apply_patch_metro_week(spark, d):
    panel = data.staged_panel(spark, d)
    return patch.apply_patch(
        weekly_panel(panel, COUNTY), patch.substitute_week_sums(panel, *PATCHED),
        ["fips", "state", "week"], data.PATCH_STATES, "prior_year",
    )


WIDE_DAYS = sql.wide_daily("fips, state, county")


def wide_days(panel: DataFrame) -> DataFrame:
    return widen(panel, [*COUNTY, "date"], "alert_type", {"count": "count"}, KINDS)


TOTAL = " + ".join(f"coalesce(sum(count_{k}), 0)" for k in KINDS)


@query("date_completeness", with_(sql.PANEL, WIDE_DAYS, f"""SELECT date, CAST({TOTAL} AS BIGINT) AS total_count,
  {' + '.join(f'count(*) FILTER (WHERE count_{k} IS NULL)' for k in KINDS)} AS null_cells FROM wide GROUP BY date"""))
def date_completeness(spark, d):
    return op.date_completeness(wide_days(data.panel(spark, d)))


@query("null_totals", with_(sql.PANEL, WIDE_DAYS, "SELECT "
       + sql.each("count(*) FILTER (WHERE count_{k} IS NULL) AS count_{k}") + " FROM wide"))
def null_totals(spark, d):
    return op.null_totals(wide_days(data.panel(spark, d)), [f"count_{k}" for k in KINDS])


def _metro_change(k: str) -> str:
    return (f"(CAST(count_{k} AS DOUBLE) - lag(count_{k}) OVER w) / nullif(CAST(count_{k} AS DOUBLE), 0)"
            f" AS change_{SHORT[k]}")


CHANGES = f"""metro AS (SELECT fips AS cbsa_code, date,
  {sql.each("CAST(coalesce(max(count) FILTER (WHERE alert_type = '{k}'), 0) AS BIGINT) AS count_{k}")} FROM panel GROUP BY ALL),
moved AS (SELECT *, {', '.join(_metro_change(k) for k in KINDS)},
  {' OR '.join(f'coalesce(count_{k} = 0 AND count_{k} <> lag(count_{k}) OVER w, false)' for k in KINDS)} AS infinite_change
  FROM metro WINDOW w AS (PARTITION BY cbsa_code ORDER BY date)),
changes AS (SELECT *, ({' + '.join(f'coalesce(change_{SHORT[k]}, 0)' for k in KINDS)}) / 3 AS mean_change FROM moved),
per_metro AS (SELECT cbsa_code, {', '.join(
    f'count(*) FILTER (WHERE infinite_change OR abs(mean_change) > {p / 100}) AS n_change_{p}' for p in op.JUMPS_PERCENT)}
  FROM changes GROUP BY cbsa_code)"""


def changes(spark, d) -> DataFrame:
    coded = data.panel(spark, d).withColumn("cbsa_code", F.col("fips"))
    wide = widen(coded, ["cbsa_code", "fips", "date"], "alert_type", {"count": "count"}, KINDS)
    return op.day_over_day_change(op.metro_day(wide, "cbsa_code"), "cbsa_code")


@query("day_over_day_change", with_(sql.PANEL, CHANGES, "SELECT * FROM changes"))
def day_over_day_change(spark, d):
    return changes(spark, d)


@query("volatility_by_metro", with_(sql.PANEL, CHANGES, "SELECT * FROM per_metro"))
def volatility_by_metro(spark, d):
    return op.volatility_by_metro(changes(spark, d), "cbsa_code")


@query("volatility_flags", with_(sql.PANEL, CHANGES, "SELECT " + ", ".join(
       f"count(*) FILTER (WHERE n_change_{p} > 10) AS n_metros_{p}" for p in op.JUMPS_PERCENT)
       + ", count(*) AS n_metros FROM per_metro"))
def volatility_flags(spark, d):
    return op.volatility_flags(changes(spark, d), "cbsa_code")


SUPPRESSED = ", ".join(
    [f"count(*) FILTER (WHERE NOT coalesce(prior_mean_{k} >= 25, false)) AS null_{SHORT[k]}" for k in KINDS]
    + [f"count(*) FILTER (WHERE prior_mean_{k} IS NULL) AS null_{SHORT[k]}_nf" for k in KINDS]
)


@query("suppression_effect", with_(sql.PANEL, sql.match(COUNTY), f"SELECT fips, {SUPPRESSED} FROM matched GROUP BY fips"))
def suppression_effect(spark, d):
    matched = daily_match_panel(data.panel(spark, d), COUNTY)
    kept = matched.withColumns({f"{c}_nf": F.col(c) for c in MEANS})
    return op.suppression_effect(baseline.suppress_small_cells(kept, MEANS, 25), "fips", "prior_mean")


WEEK_TOTAL = " + ".join(f"coalesce(sum(week_sum_{k}), 0)" for k in KINDS)


@query("national_reconcile", with_(sql.PANEL, sql.weeks(["state"]), WIDE_DAYS, f"""by_day AS (SELECT {sql.year('date')} AS year,
  {sql.block_week('date')} AS week, CAST({TOTAL} AS BIGINT) AS total_daily FROM wide GROUP BY ALL),
by_week AS (SELECT year, week, CAST({WEEK_TOTAL} AS BIGINT) AS total_weekly FROM weekly GROUP BY ALL)""",
       f"""SELECT w.*, total_daily, {sql.change('total_weekly', 'total_daily')} AS pct_change
  FROM by_week w LEFT JOIN by_day y ON y.year = w.year AND y.week = w.week"""))
def national_reconcile(spark, d):
    panel = data.staged_panel(spark, d)
    daily = wide_days(panel).withColumns({"year": F.year("date"), "week": dates.simple_week("date")})
    return op.national_reconcile(weekly_panel(panel, ["state"]), daily)


@query("spot_check", with_(sql.PANEL, sql.CASES, """a AS (SELECT fips, date, max(count) AS n FROM panel GROUP BY ALL),
b AS (SELECT fips, date, cases AS n FROM cases)""",
       """SELECT coalesce(a.fips, b.fips) AS fips, coalesce(a.date, b.date) AS date, a.n AS n_left, b.n AS n_right,
  CASE WHEN b.date IS NULL THEN 'only_left' WHEN a.date IS NULL THEN 'only_right'
    WHEN a.n IS DISTINCT FROM b.n THEN 'differs' ELSE 'same' END AS status
  FROM (SELECT nullif(fips, '00003') AS fips, date, n FROM a) a FULL JOIN (SELECT nullif(fips, '00003') AS fips, date, n FROM b) b
  ON a.fips IS NOT DISTINCT FROM b.fips AND a.date = b.date"""))
def spot_check(spark, d):
    largest = data.panel(spark, d).groupBy("fips", "date").agg(F.max("count").alias("n"))
    unknown = {"fips": F.nullif("fips", F.lit("00003"))}
    cases = data.cases(spark, d).withColumnRenamed("cases", "n")
    return keys.spot_check(largest.withColumns(unknown), cases.withColumns(unknown), ["fips", "date"], ["n"])


@query("usable_counties", with_(sql.PANEL, WIDE_DAYS, "counted AS (SELECT fips, count(*) AS n_days, "
       + ", ".join(f"count(*) FILTER (WHERE count_{k} > 40) AS good_{SHORT[k]}" for k in KINDS)
       + " FROM wide GROUP BY fips), judged AS (SELECT *, "
       + ", ".join(f"good_{SHORT[k]} / n_days > 0.2 AS enough_{SHORT[k]}" for k in KINDS) + " FROM counted)",
       "SELECT *, " + " AND ".join(f"enough_{SHORT[k]}" for k in KINDS) + " AS mostly_good FROM judged"))
def usable_counties(spark, d):
    return op.usable_counties(wide_days(data.panel(spark, d)), least=40)


@query("histogram_log", with_(sql.PANEL, """SELECT alert_type, CAST(floor(log10(count) * 5) AS INTEGER) AS bin, count(*) AS n
  FROM panel WHERE count > 0 GROUP BY ALL"""))
def histogram_log(spark, d):
    return op.histogram_log(data.panel(spark, d), "count", ["alert_type"])


BOXES = """quartiles AS (SELECT alert_type, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.5) AS median,
  quantile_cont(count, 0.75) AS q3 FROM panel GROUP BY alert_type)"""


@query("box_stats", with_(sql.PANEL, BOXES, """SELECT q.*,
  min(count) FILTER (WHERE count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(count) FILTER (WHERE count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE count NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM panel p JOIN quartiles q ON q.alert_type = p.alert_type GROUP BY ALL"""))
def box_stats(spark, d):
    return op.box_stats(data.staged_panel(spark, d), "count", ["alert_type"])


@query("numeric_summary", """SELECT min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max,
  count(*) FILTER (WHERE l_extendedprice IS NULL) AS n_null FROM lineitem""")
def numeric_summary(spark, d):
    summary = op.numeric_summary(data.table(spark, d, "lineitem"), "l_extendedprice")
    return data.shown(summary, "q1", "median", "mean", "q3", digits=4)


@query("pair_counts", with_(sql.PANEL, WIDE_DAYS,
       "SELECT count_ACCIDENT, count_JAM, count(*) AS n FROM wide GROUP BY ALL"))
def pair_counts(spark, d):
    return op.pair_counts(wide_days(data.panel(spark, d)), "count_ACCIDENT", "count_JAM")


# The value of months whose number of cells is a multiple of five or seven is unknown.
@query("gap_report", with_(sql.PANEL, """months AS (SELECT fips, date_trunc('month', date)::DATE AS period,
  CASE WHEN count(*) % 5 <> 0 THEN nullif(count(*) % 7, 0) END AS value FROM panel GROUP BY ALL),
spans AS (SELECT fips, unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH))::DATE AS period
  FROM months GROUP BY fips)""",
       """SELECT s.fips, s.period, 'missing' AS gap FROM spans s ANTI JOIN months m ON m.fips = s.fips AND m.period = s.period
  UNION ALL SELECT fips, period, 'null' FROM months WHERE value IS NULL"""))
def gap_report(spark, d):
    n = F.count(F.lit(1))
    months = (
        data.panel(spark, d)
        .groupBy("fips", dates.month_start("date").alias("period"))
        .agg(F.when(n % 5 != 0, F.nullif(n % 7, F.lit(0))).alias("value"))
    )
    return op.gap_report(months, ["fips"], "period", "value")


# The box plot of model errors, drawn per event type.
@query("error_box_stats", with_(sql.PANEL, EXPECTED, """errors AS (SELECT state, fips, alert_type,
  avg((count - pred_count) * (count - pred_count)) AS mse FROM expected WHERE pred_count IS NOT NULL GROUP BY ALL)""",
       """SELECT alert_type, round(quantile_cont(mse, 0.25), 6) AS q1, round(quantile_cont(mse, 0.5), 6) AS median,
  round(quantile_cont(mse, 0.75), 6) AS q3 FROM errors GROUP BY alert_type"""))
def error_box_stats(spark, d):
    error = F.col("count") - F.col("pred_count")
    errors = expected(spark, d).dropna(subset=["pred_count"]).groupBy("state", "fips", "alert_type").agg(
        F.avg(error * error).alias("mse")
    )
    boxes = op.box_stats(errors, "mse", ["alert_type"]).select("alert_type", "q1", "median", "q3")
    return data.shown(boxes, "q1", "median", "q3")


# Missing cells of the completed panel, from true gaps in reporting.
@query("null_cells_by_kind", with_(sql.FULL, """SELECT alert_type, count(*) FILTER (WHERE "count" IS NULL) AS null_cells
  FROM full_panel GROUP BY alert_type"""))
def null_cells_by_kind(spark, d):
    return full_panel(spark, d).groupBy("alert_type").agg(op.nulls.null_count("count").alias("null_cells"))
