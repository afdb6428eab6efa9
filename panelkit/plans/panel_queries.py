"""Queries on panel building and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.constants import PAIR
from panelkit.functions import dates, text
from panelkit.operators import keys, metro, panel as op
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.registry import query
from panelkit.plans.sql import with_
from panelkit.session import stage

CELL = "fips, date, alert_type"


@query("daily_counts", with_(sql.DAILY, f"SELECT {CELL}, count FROM daily"))
def daily_counts(spark, d):
    place = text.place_code("state_part", "county_part")
    return op.daily_counts(data.raw_counts(spark, d), place, "date", "alert_type", "count")


def _grid(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    daily, cases = data.staged_daily(spark, d), data.cases(spark, d)
    places = op.known_places(data.places(spark, d), "fips", daily, cases)
    return op.complete_grid(daily, places), places, daily


def _filled(spark, d) -> DataFrame:
    daily, cases = data.staged_daily(spark, d), data.cases(spark, d)
    places = op.known_places(data.places(spark, d), "fips", daily, cases)
    return op.complete_panel(daily, places)


@query("known_places", with_(sql.PLACES, sql.DAILY, sql.CASES,
       "SELECT * FROM places WHERE fips IN (SELECT fips FROM daily UNION SELECT fips FROM cases)"))
def known_places(spark, d):
    return op.known_places(data.places(spark, d), "fips", data.daily(spark, d), data.cases(spark, d))


@query("complete_grid", with_(sql.GRID, "SELECT * FROM gridded"))
def complete_grid(spark, d):
    return _grid(spark, d)[0]


@query("fill_true_zeros", with_(sql.FILLED, "SELECT * FROM filled"))
def fill_true_zeros(spark, d):
    return op.fill_true_zeros(_grid(spark, d)[0], "count", ["fips", "date"])


@query("complete_panel", with_(sql.FILLED, "SELECT * FROM filled"))
def complete_panel(spark, d):
    return _filled(spark, d)


@query("attach_measure", with_(sql.ATTACHED, "SELECT * FROM attached"))
def attach_measure(spark, d):
    return op.attach_measure(_filled(spark, d), data.cases(spark, d), ["fips", "date"])


@query("attach_dimension", with_(sql.FILLED,
       "SELECT f.*, k.state, k.county FROM filled f LEFT JOIN known k ON f.fips = k.fips"))
def attach_dimension(spark, d):
    grid, places, _ = _grid(spark, d)
    return op.attach_dimension(op.fill_true_zeros(grid, "count", ["fips", "date"]), places)


@query("fill_from_first_observed", with_(sql.FULL, f"SELECT {CELL}, count, cases, deaths FROM full_panel"))
def fill_from_first_observed(spark, d):
    attached = op.attach_measure(_filled(spark, d), data.cases(spark, d), ["fips", "date"])
    return op.fill_from_first_observed(stage(attached, "attached"), "date", ["cases", "deaths"])


@query("calendar_parts", with_(sql.DAILY, f"""SELECT DISTINCT date, {sql.year('date')} AS year, {sql.month('date')} AS month,
  {sql.dow('date')} AS dow, {sql.weekday('date')} AS day_week, dayofweek(date) IN (0, 6) AS weekend,
  {sql.block_week('date')} AS week_year, CAST(weekofyear(date) AS INTEGER) AS iso_week,
  {sql.epi_year('date')} AS epi_year, {sql.epi_week('date')} AS epi_week FROM daily"""))
def calendar_parts(spark, d):
    days = data.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return dates.calendar_parts(days)


@query("exclude_kinds", with_(sql.DAILY, f"SELECT {CELL}, count FROM daily WHERE alert_type <> 'WEATHERHAZARD'"))
def exclude_kinds(spark, d):
    return op.exclude_kinds(data.daily(spark, d), ["WEATHERHAZARD"])


def full_panel(spark, d) -> DataFrame:
    return op.build_panel(data.staged_daily(spark, d), data.cases(spark, d), data.places(spark, d))


@query("build_panel", with_(sql.FULL, f"""SELECT *, {sql.year('date')} AS year, {sql.month('date')} AS month,
  {sql.dow('date')} AS dow, {sql.weekday('date')} AS day_week, dayofweek(date) IN (0, 6) AS weekend
  FROM full_panel"""))
def build_panel(spark, d):
    return full_panel(spark, d)


@query("zero_fill_days", with_(sql.HOURLY, """places AS (SELECT geoid, min(user_id) AS user_id FROM hourly GROUP BY geoid),
daily AS (SELECT geoid, date, CAST(sum(count) AS BIGINT) AS sum_count, count(*) AS samp FROM hourly GROUP BY ALL)""",
       """SELECT p.geoid, p.user_id, x.date, coalesce(sum_count, 0) AS sum_count, coalesce(samp, 0) AS samp
  FROM places p CROSS JOIN (SELECT DISTINCT date FROM hourly) x
  LEFT JOIN daily y ON y.geoid = p.geoid AND y.date = x.date"""))
def zero_fill_days(spark, d):
    return op.zero_fill_days(data.hourly_events(spark, d), "geoid", "date", "count", ["user_id"])


STORM = """storm AS (SELECT CAST(user_id // 1000 AS INTEGER) AS statefp, CAST(user_id % 1000 AS INTEGER) AS countyfp,
  date, sub_type, count FROM hourly),
subtypes AS (SELECT statefp, date, printf('%02d', statefp) || printf('%03d', countyfp) AS fips, sub_type,
  count(*) AS total_count, CAST(coalesce(sum(count), 0) AS BIGINT) AS sum_counts FROM storm GROUP BY ALL)"""


def storm_counts(spark, d) -> DataFrame:
    events = data.hourly_events(spark, d).select(
        F.floor(F.col("user_id") / 1000).cast("int").alias("statefp"),
        (F.col("user_id") % 1000).cast("int").alias("countyfp"), "date", "sub_type", "count",
    )
    return metro.subtype_day_counts(events, "statefp", "countyfp", "date", "sub_type", "count")


@query("subtype_day_counts", with_(sql.HOURLY, STORM, "SELECT * FROM subtypes"))
def subtype_day_counts(spark, d):
    return storm_counts(spark, d)


CORNERS = (("1", 0, 0), ("2", 1, 0), ("3", 1, 1), ("4", 0, 1))

POLYGONS = f"""named AS (SELECT printf('%05d', n_nationkey) AS fips, r_name || ',' || n_name AS polyname
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)),
vertices AS (SELECT r_name AS region, n_name AS subregion, CAST(n_nationkey AS BIGINT) AS "group", CAST(o AS INTEGER) AS ord,
  CAST(n_nationkey % 5 + x AS DOUBLE) AS long, CAST(n_nationkey // 5 + y AS DOUBLE) AS lat
  FROM nation JOIN region ON n_regionkey = r_regionkey
  CROSS JOIN (VALUES {", ".join(f"({o}, {x}, {y})" for o, x, y in CORNERS)}) c(o, x, y)),
outline AS (SELECT v.*, n.fips FROM vertices v LEFT JOIN named n
  ON regexp_extract(n.polyname, '{PAIR}', 1) = v.region
  AND regexp_extract(n.polyname, '{PAIR}', 2) = v.subregion)"""


def polygons(spark, d) -> DataFrame:
    nations = data.table(spark, d, "nation").join(
        data.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    reporting = data.table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    names = keys.keep_members(nations, reporting, "n_nationkey").select(
        text.padded("n_nationkey", 5).alias("fips"), F.concat_ws(",", "r_name", "n_name").alias("polyname")
    )
    corners = F.array(*[
        F.struct(
            F.lit(int(o)).alias("ord"),
            (F.col("n_nationkey") % 5 + x).cast("double").alias("long"),
            (F.floor(F.col("n_nationkey") / 5) + y).cast("double").alias("lat"),
        )
        for o, x, y in CORNERS
    ])
    vertices = nations.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("subregion"),
        F.col("n_nationkey").cast("long").alias("group"), F.inline(corners),
    )
    return metro.county_name_dim(names, vertices)


@query("county_name_dim", with_(POLYGONS, "SELECT * FROM outline"))
def county_name_dim(spark, d):
    return polygons(spark, d)


@query("map_frame", with_(sql.HOURLY, STORM, POLYGONS, """mapped AS (SELECT * FROM subtypes WHERE statefp = 0),
frame AS (SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(long) AS min_long, max(long) AS max_long
  FROM outline WHERE fips IN (SELECT fips FROM mapped)),
top AS (SELECT max(sum_counts) AS largest_count FROM mapped WHERE sub_type = 'error')""",
       """SELECT o.fips, o."group", m.date, m.sub_type, m.sum_counts, o.ord, o.long, o.lat, frame.*, largest_count
  FROM outline o JOIN mapped m ON m.fips = o.fips CROSS JOIN frame CROSS JOIN top
  WHERE m.date = DATE '2024-01-10' AND m.sub_type = 'error'"""))
def map_frame(spark, d):
    frame = metro.map_frame(polygons(spark, d), storm_counts(spark, d), ("statefp", 0), "2024-01-10", "error")
    return frame.select(
        "fips", "group", "date", "sub_type", "sum_counts", "ord", "long", "lat",
        "min_lat", "max_lat", "min_long", "max_long", "largest_count",
    )


@query("event_paths", """SELECT user_id, count(*) AS n_points, 'LINESTRING(' || string_agg(
    CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) || ' ' || CAST(event_id % 90 AS VARCHAR), ',' ORDER BY event_id)
    || ')' AS geometry
  FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error'
    AND x.ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 00:00:00')
  GROUP BY user_id""")
def event_paths(spark, d):
    events = data.hourly_events(spark, d)
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-05 00:00:00", "2024-01-06 00:00:00"))
    failed = events.where((F.col("sub_type") == "error") & F.col("ts").between(start, end))
    x, y = F.col("value").cast("decimal(10,2)"), F.col("event_id") % 90
    return metro.event_paths(events, failed, "user_id", "event_id", x, y)


METRO = "fips, state, county, date, alert_type, count, cbsa_code, csa_title, metro_type, central_outlying"


def _metro_sql(condition: str) -> str:
    return with_(sql.PANEL, sql.DELINEATION, f"""SELECT p.*, m.* EXCLUDE (fips) FROM panel p
  JOIN delineation m ON p.fips = m.fips WHERE {condition}""")


@query("metro_filter", _metro_sql("true"))
def metro_filter(spark, d):
    return metro.metro_filter(data.panel(spark, d), data.delineation(spark, d))


@query("metro_filter_metropolitan", _metro_sql("metro_type = 'Metropolitan Statistical Area'"))
def metro_filter_metropolitan(spark, d):
    return metro.metro_filter(
        data.panel(spark, d), data.delineation(spark, d), metro_type="Metropolitan Statistical Area"
    )


@query("metro_filter_central", _metro_sql("csa_title IS NOT NULL AND central_outlying = 'Central'"))
def metro_filter_central(spark, d):
    return metro.metro_filter(
        data.panel(spark, d), data.delineation(spark, d), require_csa=True, central_only=True
    )


COUNTY = ["fips", "state", "county"]


def metro_days(spark, d, panel: DataFrame | None = None) -> DataFrame:
    """Daily sums per metro area, with the matched means of the year before."""
    matched = op.daily_match_panel(data.panel(spark, d) if panel is None else panel, COUNTY)
    central = metro.metro_filter(matched, data.delineation(spark, d), require_csa=True, central_only=True)
    return metro.metro_rollup_day(central)


def metro_weeks(spark, d, panel: DataFrame | None = None) -> DataFrame:
    """Weekly sums per metro area, with the year before and the week before."""
    weekly = op.weekly_panel(data.panel(spark, d) if panel is None else panel, COUNTY)
    central = metro.metro_filter(weekly, data.delineation(spark, d), require_csa=True, central_only=True)
    return metro.metro_rollup_week(central)


def _sums(measures) -> str:
    return ", ".join(
        sql.each(f"coalesce(sum({m}_{{k}}), 0)" + f" AS {m}_{{k}}") if m == "prior_mean"
        else sql.each(f"CAST(coalesce(sum({m}_{{k}}), 0) AS BIGINT) AS {m}_{{k}}")
        for m in measures
    )


METRO_DAYS = f"""{sql.PANEL},\n{sql.DELINEATION},\n{sql.match(COUNTY)},
metro_days AS (SELECT csa_title, state, date, year, month, dow, {_sums(('count', 'prior_mean'))}
  FROM matched x JOIN delineation m ON x.fips = m.fips
  WHERE csa_title IS NOT NULL AND central_outlying = 'Central' GROUP BY ALL)"""

METRO_WEEKS = f"""{sql.PANEL},\n{sql.DELINEATION},\n{sql.weeks(COUNTY)},
metro_weeks AS (SELECT csa_title, state, year, month_start, week, {_sums(('week_sum', 'prior_year', 'prev_week'))}
  FROM weekly x JOIN delineation m ON x.fips = m.fips
  WHERE csa_title IS NOT NULL AND central_outlying = 'Central' GROUP BY ALL)"""

MEANS = [f"prior_mean_{k}" for k in sql.KINDS]


@query("metro_rollup_day", with_(METRO_DAYS, f"""SELECT * REPLACE ({sql.each('round(prior_mean_{k}, 6) AS prior_mean_{k}')})
  FROM metro_days"""))
def metro_rollup_day(spark, d):
    return data.shown(metro_days(spark, d), *MEANS)


@query("metro_rollup_week", with_(METRO_WEEKS, "SELECT * FROM metro_weeks"))
def metro_rollup_week(spark, d):
    return metro_weeks(spark, d)


@query("weekly_panel", with_(sql.PANEL, sql.weeks(COUNTY, window=data.WINDOW), "SELECT * FROM weekly"))
def weekly_panel(spark, d):
    return op.weekly_panel(data.panel(spark, d), COUNTY, window=data.WINDOW)


@query("daily_match_panel", with_(sql.PANEL, sql.match(COUNTY), "SELECT * FROM matched"))
def daily_match_panel(spark, d):
    return op.daily_match_panel(data.panel(spark, d), COUNTY)


@query("last_complete_day", with_(sql.FILLED, """per_day AS (SELECT date, CAST(coalesce(sum("count"), 0) AS BIGINT) AS total_count,
  count("count") AS known_cells, count(*) - count("count") AS null_cells FROM filled GROUP BY date)""",
       "SELECT * FROM per_day WHERE date = (SELECT max(date) FROM per_day WHERE known_cells > 0)"))
def last_complete_day(spark, d):
    return op.last_complete_day(_filled(spark, d))
