"""Queries on period comparison and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.constants import KINDS
from panelkit.functions import dates
from panelkit.operators import compare as op
from panelkit.operators.panel import zero_fill_days
from panelkit.operators.reshape import widen
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.panel_queries import METRO_DAYS, METRO_WEEKS, metro_days, metro_weeks
from panelkit.plans.registry import query
from panelkit.plans.sql import with_
from panelkit.session import stage

WEEKS = f"{sql.PANEL},\n{sql.weeks(['state'], window=data.WINDOW)}"
PAIRS = [(k, base, name) for base, name in op.BASES.items() for k in ("JAM", "ACCIDENT")]


def _weights() -> str:
    return ", ".join(
        f"CAST({base}_{k} AS DOUBLE) / nullif(sum({base}_{k}) OVER (PARTITION BY year, week), 0)"
        f" AS weight_{op.SHORT[k]}_{name}"
        for k, base, name in PAIRS
    )


def _changes() -> str:
    return ", ".join(
        f"100 * ({sql.change(f'week_sum_{k}', f'{base}_{k}')}) AS pct_{op.SHORT[k]}_{name}" for k, base, name in PAIRS
    )


def _rounded(names) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


WEIGHT_NAMES = [f"weight_{op.SHORT[k]}_{name}" for k, _, name in PAIRS]


@query("week_share_weights", with_(WEEKS, f"weighted AS (SELECT *, {_weights()} FROM weekly)",
       f"SELECT state, year, week, {_rounded(WEIGHT_NAMES)} FROM weighted"))
def week_share_weights(spark, d):
    weighted = op.week_share_weights(data.state_weeks(spark, d))
    return data.shown(weighted.select("state", "year", "week", *WEIGHT_NAMES), *WEIGHT_NAMES)


@query("pct_changes", with_(WEEKS, f"SELECT *, {_changes()} FROM weekly"))
def pct_changes(spark, d):
    return op.pct_changes(data.state_weeks(spark, d))


def _weighted_mean(x: str, w: str) -> str:
    return f"""CASE WHEN count(*) FILTER (WHERE {w} IS NULL OR ({w} <> 0 AND {x} IS NULL)) > 0 THEN NULL
  ELSE sum(CASE WHEN {w} <> 0 THEN {x} * {w} END) / nullif(sum({w}), 0) END"""


NATIONAL = f"""{WEEKS},
weighted AS (SELECT *, {_weights()}, {_changes()} FROM weekly),
summed AS (SELECT year, week, CAST(coalesce(sum(week_sum_JAM), 0) AS BIGINT) AS weekly_sum_jam,
  CAST(coalesce(sum(prior_year_JAM), 0) AS BIGINT) AS weekly_prior_jam,
  {', '.join(f"{_weighted_mean(f'pct_jam_{n}', f'weight_jam_{n}')} AS pct_jam_{n}" for n in op.BASES.values())}
  FROM weighted GROUP BY year, week),
national AS (SELECT *, CAST(100 * (weekly_sum_jam - weekly_prior_jam) AS DOUBLE)
  / nullif(CAST(weekly_prior_jam AS DOUBLE), 0) AS change_from_prior_jam FROM summed)"""

PCT_NAMES = [f"pct_jam_{n}" for n in op.BASES.values()]


@query("national_week_index", with_(NATIONAL, f"SELECT * REPLACE ({_rounded(PCT_NAMES)}) FROM national"))
def national_week_index(spark, d):
    return data.shown(op.national_week_index(data.state_weeks(spark, d)), *PCT_NAMES)


LOOKUP = f"""span AS (SELECT min(CAST(l_shipdate AS DATE)) AS a, max(CAST(l_shipdate AS DATE)) AS b FROM lineitem),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
lookup AS (SELECT {sql.epi_year('date')} AS year, {sql.epi_week('date')} AS week, max(date) AS week_ending_date
  FROM days GROUP BY ALL HAVING count(*) = 7)"""


def lookup(spark, d) -> DataFrame:
    shipped = data.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return op.week_ending_lookup(dates.days_spanned(shipped))


@query("week_ending_lookup", with_(LOOKUP, "SELECT * FROM lookup"))
def week_ending_lookup(spark, d):
    return lookup(spark, d)


SINCE = 1996

TROUGH = f"""{NATIONAL},
low AS (SELECT year AS year_of_lowest, week AS week_of_lowest, weekly_sum_jam AS lowest_total FROM national
  WHERE year * 100 + week >= {SINCE * 100 + 10} ORDER BY weekly_sum_jam, year, week LIMIT 1)"""

PEAK = f"""{TROUGH},
high AS (SELECT year AS year_of_peak, week AS week_of_peak, weekly_sum_jam AS peak_total FROM national, low
  WHERE year * 100 + week >= year_of_lowest * 100 + week_of_lowest ORDER BY weekly_sum_jam DESC, year, week LIMIT 1)"""


def national_weeks(spark, d) -> DataFrame:
    return stage(op.national_week_index(data.state_weeks(spark, d)), "weeks")


@query("trough", with_(TROUGH, "SELECT * FROM low"))
def trough(spark, d):
    return op.trough(op.national_week_index(data.state_weeks(spark, d)), SINCE, "weekly_sum_jam")


@query("peak_after", with_(PEAK, "SELECT * FROM high"))
def peak_after(spark, d):
    weeks = national_weeks(spark, d)
    return op.peak_after(weeks, op.trough(weeks, SINCE, "weekly_sum_jam"), "weekly_sum_jam")


@query("latest_week_report", with_(PEAK, LOOKUP, f"""SELECT n.week, week_ending_date, weekly_sum_jam, weekly_prior_jam,
  change_from_prior_jam, low.*, high.* FROM national n LEFT JOIN lookup k ON k.year = n.year AND k.week = n.week
  CROSS JOIN low CROSS JOIN high WHERE n.year = {data.TARGET_YEAR} ORDER BY n.week DESC LIMIT 1"""))
def latest_week_report(spark, d):
    return op.latest_week_report(national_weeks(spark, d), lookup(spark, d), data.TARGET_YEAR, SINCE)


@query("weekly_totals_check", with_(WEEKS, f"""sums AS (SELECT year, week,
  {', '.join(f'CAST(coalesce(sum(week_sum_{k}), 0) AS BIGINT) AS {op.SHORT[k]}' for k in KINDS)},
  {' + '.join(f'coalesce(sum(window_mean_{k}), 0)' for k in KINDS)} AS total_base FROM weekly GROUP BY year, week),
totals AS (SELECT *, {' + '.join(op.SHORT[k] for k in KINDS)} AS total_now FROM sums)""",
       f"""SELECT * REPLACE (round(total_base, 6) AS total_base),
  round({sql.change('total_now', 'total_base')}, 6) AS pct_change FROM totals"""))
def weekly_totals_check(spark, d):
    return data.shown(op.weekly_totals_check(data.state_weeks(spark, d)), "total_base", "pct_change")


def _capped_day(k: str) -> str:
    # Whole percents are kept as doubles; the cap is strict.
    change = f"100 * {sql.rounded(sql.change(f'count_{k}', f'prior_mean_{k}'), 2)}"
    return f"CASE WHEN {change} < 500 THEN {change} END AS pct_{op.SHORT[k]}"


def _capped_week(k: str, base: str, suffix: str) -> str:
    diff = f"(CAST(week_sum_{k} AS DOUBLE) - {base}_{k})"
    change = sql.rounded(f"100 * {diff} / nullif({base}_{k}, 0)", 2)
    return f"CASE WHEN {change} < 500 THEN {change} END AS pct_{op.SHORT[k]}{suffix}"


CAPPED_DAYS = f"""{METRO_DAYS},
capped_days AS (SELECT * REPLACE ({sql.each('nullif(prior_mean_{k}, 0) AS prior_mean_{k}')}),
  {', '.join(_capped_day(k) for k in KINDS)} FROM metro_days)"""

CAPPED_WEEKS = f"""{METRO_WEEKS},
capped_weeks AS (SELECT * REPLACE ({sql.each('nullif(prior_year_{k}, 0) AS prior_year_{k}')},
  {sql.each('nullif(prev_week_{k}, 0) AS prev_week_{k}')}),
  {', '.join(_capped_week(k, b, s) for b, s in (('prior_year', ''), ('prev_week', '_prev')) for k in KINDS)}
  FROM metro_weeks)"""

DAY_MEANS = [f"prior_mean_{k}" for k in KINDS]


def capped_days(spark, d, panel: DataFrame | None = None) -> DataFrame:
    return op.capped_change_day(metro_days(spark, d, panel))


def capped_weeks(spark, d, panel: DataFrame | None = None) -> DataFrame:
    return op.capped_change_week(metro_weeks(spark, d, panel))


@query("capped_change_day", with_(CAPPED_DAYS, f"SELECT * REPLACE ({_rounded(DAY_MEANS)}) FROM capped_days"))
def capped_change_day(spark, d):
    return data.shown(capped_days(spark, d), *DAY_MEANS)


@query("capped_change_week", with_(CAPPED_WEEKS, "SELECT * FROM capped_weeks"))
def capped_change_week(spark, d):
    return capped_weeks(spark, d)


DAY_SHOWN = ["csa_title", "pct_crash", "pct_weh", "pct_jam"]
WEEK_SHOWN = [*DAY_SHOWN, "pct_crash_prev", "pct_weh_prev", "pct_jam_prev"]


@query("latest_by_state_day", with_(CAPPED_DAYS, f"""SELECT {', '.join(DAY_SHOWN)} FROM capped_days
  WHERE state = 'ASIA' AND date = (SELECT max(date) FROM capped_days)"""))
def latest_by_state_day(spark, d):
    return op.latest_by_state(stage(capped_days(spark, d), "days"), "ASIA", F.col("date"), DAY_SHOWN)


@query("latest_by_state_week", with_(CAPPED_WEEKS, f"""SELECT {', '.join(WEEK_SHOWN)} FROM capped_weeks
  WHERE state = 'ASIA' AND year * 100 + week = (SELECT max(year * 100 + week) FROM capped_weeks)"""))
def latest_by_state_week(spark, d):
    period = F.col("year") * 100 + F.col("week")
    return op.latest_by_state(stage(capped_weeks(spark, d), "weeks"), "ASIA", period, WEEK_SHOWN)


@query("metro_scorecard", with_(CAPPED_DAYS, CAPPED_WEEKS.removeprefix(sql.PANEL + ",\n" + sql.DELINEATION + ",\n"), """
day AS (SELECT * FROM capped_days WHERE csa_title = 'ASIA'
  AND date = (SELECT max(date) FROM capped_days)),
week AS (SELECT * FROM capped_weeks WHERE csa_title = 'ASIA'
  AND year * 100 + week = (SELECT max(year * 100 + week) FROM capped_weeks))""",
       """SELECT 'Daily' AS time_period, 'From Prior Year' AS comparison, pct_crash AS safety_index, pct_jam AS congestion_index
  FROM day WHERE state = 'ASIA'
  UNION ALL SELECT 'Weekly', 'From Prior Year', pct_crash, pct_jam FROM week WHERE state = 'ASIA'
  UNION ALL SELECT 'Weekly', 'From Previous Week', pct_crash_prev, pct_jam_prev FROM week WHERE state = 'ASIA'"""))
def metro_scorecard(spark, d):
    panel = data.staged_panel(spark, d)
    days, weeks = stage(capped_days(spark, d, panel), "days"), stage(capped_weeks(spark, d, panel), "weeks")
    return op.metro_scorecard(days, weeks, "ASIA", "ASIA")


@query("state_weekly_counts", with_(sql.PANEL, f"""SELECT {sql.year('date')} AS year, {sql.epi_week('date')} AS week,
  CAST(coalesce(sum(count), 0) AS BIGINT) AS total_count FROM panel
  WHERE fips LIKE '0001%' AND alert_type = 'ACCIDENT' AND year(date) IN (1999, 2000)
  AND {sql.epi_week('date')} > 5 AND {sql.epi_week('date')} < 25 GROUP BY ALL"""))
def state_weekly_counts(spark, d):
    return op.state_weekly_counts(data.panel(spark, d), "0001", "ACCIDENT", (1999, 2000), 5, 25)


def _top(period: str, by: str, source: str, value: str = "count") -> str:
    return f"""totals AS (SELECT {by}, {period}, CAST(sum({value}) AS BIGINT) AS sum_count, count(*) AS samp
  FROM {source} GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY sum_count DESC, {period}) AS INTEGER) AS rank FROM totals)"""


@query("top_periods_hour", with_(sql.HOURLY, _top("hour", "geoid", "hourly"), "SELECT * FROM ranked WHERE rank <= 5"))
def top_periods_hour(spark, d):
    return op.top_periods(data.hourly_events(spark, d), ["geoid"], "hour", "count")


@query("top_periods_month", with_(sql.PANEL, "months AS (SELECT *, strftime(date, '%Y-%m') AS ym FROM panel)",
       _top("ym", "fips, county", "months"), "SELECT * FROM ranked WHERE rank <= 5"))
def top_periods_month(spark, d):
    months = data.panel(spark, d).withColumn("ym", dates.year_month("date"))
    return op.top_periods(months, ["fips", "county"], "ym", "count")


ZERO_DAYS = f"""{sql.HOURLY},
zero_days AS (SELECT p.geoid, x.date, coalesce(y.sum_count, 0) AS sum_count
  FROM (SELECT DISTINCT geoid FROM hourly) p CROSS JOIN (SELECT DISTINCT date FROM hourly) x
  LEFT JOIN (SELECT geoid, date, sum(count) AS sum_count FROM hourly GROUP BY ALL) y
  ON y.geoid = p.geoid AND y.date = x.date),
coverage AS (SELECT geoid, count(*) AS n_days, count(*) FILTER (WHERE sum_count > 0) AS obs_days,
  count(*) FILTER (WHERE sum_count > 0) / count(*) AS pct_obs FROM zero_days GROUP BY geoid)"""


def zero_days(spark, d) -> DataFrame:
    return zero_fill_days(data.hourly_events(spark, d), "geoid", "date", "count", ["user_id"])


@query("coverage_by_place", with_(ZERO_DAYS, "SELECT * FROM coverage"))
def coverage_by_place(spark, d):
    return op.coverage_by_place(zero_days(spark, d), "geoid")


@query("coverage_stats", with_(ZERO_DAYS, """SELECT min(pct_obs) AS min_pct, round(median(pct_obs), 6) AS med_pct,
  round(avg(pct_obs), 6) AS mean_pct, max(pct_obs) AS max_pct FROM coverage"""))
def coverage_stats(spark, d):
    return data.shown(op.coverage_stats(zero_days(spark, d), "geoid"), "med_pct", "mean_pct")


@query("same_month_compare", with_(sql.PANEL, f"""SELECT *, {sql.year('date')} AS year, CAST(day(date) AS INTEGER) AS day_of_month
  FROM panel WHERE date BETWEEN DATE '1999-10-01' AND DATE '1999-10-30'
  OR date BETWEEN DATE '2000-10-01' AND DATE '2000-10-30'"""))
def same_month_compare(spark, d):
    ranges = [("1999-10-01", "1999-10-30"), ("2000-10-01", "2000-10-30")]
    return op.same_month_compare(data.panel(spark, d), ranges)


@query("filter_years_months", with_(sql.PANEL, f"""SELECT *, {sql.year('date')} AS year, {sql.month('date')} AS month FROM panel
  WHERE year(date) IN (1998, 1999, 2000) AND month(date) IN (1, 2, 3) AND state IN ('ASIA', 'EUROPE')
  AND alert_type = 'ACCIDENT'"""))
def filter_years_months(spark, d):
    return op.filter_years_months(
        data.panel(spark, d), years=(1998, 1999, 2000), months=("01", "02", "03"),
        states=("ASIA", "EUROPE"), kinds=("ACCIDENT",),
    )


@query("reference_counties", with_(sql.PANEL, f"""SELECT p.fips, p.date, p.alert_type, p.count, n.n_name AS name,
  strftime(p.date, '%Y-%m') AS ym FROM panel p JOIN nation n ON printf('%05d', n.n_nationkey) = p.fips
  WHERE n.n_nationkey < 10"""))
def reference_counties(spark, d):
    # Listed twice each, to be reduced to one row.
    listed = data.table(spark, d, "nation").where("n_nationkey < 10").select(
        data.padded("n_nationkey", 5).alias("fips"), F.col("n_name").alias("name"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("line"),
    )
    kept = op.reference_counties(data.daily(spark, d), listed, "fips", "line")
    return kept.drop("line")


@query("active_days", with_(ZERO_DAYS, """SELECT geoid, count(*) FILTER (WHERE sum_count > 0) AS active_days
  FROM zero_days WHERE date > DATE '2024-01-10' GROUP BY geoid"""))
def active_days(spark, d):
    return op.active_days(zero_days(spark, d), "geoid", "2024-01-10")


@query("combined_daily_total", with_(sql.PANEL, sql.wide_daily("fips, state"), f"""SELECT *,
  {' + '.join(f'count_{k}' for k in KINDS)} AS combined FROM wide WHERE state = 'EUROPE'"""))
def combined_daily_total(spark, d):
    wide = widen(data.panel(spark, d), ["fips", "state", "date"], "alert_type", {"count": "count"}, KINDS)
    return op.combined_daily_total(wide, "EUROPE")
