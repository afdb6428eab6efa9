"""Fragments of the oracle SQL, in the dialect of the checking engine."""

from __future__ import annotations

from panelkit.constants import KINDS

DOUBLE = "DOUBLE"


def dow(d: str) -> str:
    return f"CAST(dayofweek({d}) AS INTEGER)"


def wednesday(d: str) -> str:
    return f"({d} + (3 - {dow(d)}))"


def saturday(d: str) -> str:
    return f"({d} + (6 - {dow(d)}))"


def block_week(d: str) -> str:
    return f"CAST(floor((dayofyear({d}) - 1) / 7) + 1 AS INTEGER)"


def epi_week(d: str) -> str:
    return block_week(wednesday(d))


def epi_year(d: str) -> str:
    return f"CAST(year({wednesday(d)}) AS INTEGER)"


def year(d: str) -> str:
    return f"CAST(year({d}) AS INTEGER)"


def month(d: str) -> str:
    return f"strftime({d}, '%m')"


def weekday(d: str) -> str:
    return f"dayname({d})"


def rounded(x: str, digits: int) -> str:
    """Half up on the text of the double, which is its shortest decimal."""
    return f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,17)), {digits}) AS DOUBLE)"


def long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def change(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) - {b}) / nullif(CAST({b} AS DOUBLE), 0)"


def each(template: str, kinds=KINDS) -> str:
    """The template once per kind, ``{k}`` replaced, joined by commas."""
    return ", ".join(template.replace("{k}", k) for k in kinds)


def with_(*parts: str) -> str:
    *ctes, final = parts
    return "WITH " + ",\n".join(ctes) + "\n" + final


PLACES = """places AS (SELECT printf('%05d', n_nationkey) AS fips, r_name AS state, n_name AS county
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

DAILY = """daily AS (SELECT printf('%05d', s_nationkey) AS fips, CAST(l_shipdate AS DATE) AS date,
  CASE l_returnflag WHEN 'A' THEN 'ACCIDENT' WHEN 'N' THEN 'JAM' WHEN 'R' THEN 'WEATHERHAZARD' END AS alert_type,
  CAST(sum(l_quantity) AS BIGINT) AS count
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

PANEL_ONLY = """panel AS (SELECT p.fips, p.state, p.county, d.date, d.alert_type, d.count
  FROM daily d JOIN places p ON d.fips = p.fips)"""

PANEL = f"{PLACES},\n{DAILY},\n{PANEL_ONLY}"

CASES = """cases AS (SELECT fips, date, CASE WHEN date >= DATE '1996-06-01' THEN cases END AS cases,
  CASE WHEN date >= DATE '1996-06-01' THEN deaths END AS deaths
  FROM (SELECT printf('%05d', c_nationkey) AS fips, CAST(o_orderdate AS DATE) AS date,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS cases,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS deaths
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""

GRID = f"""{PLACES},\n{DAILY},\n{CASES},
known AS (SELECT * FROM places WHERE fips IN (SELECT fips FROM daily UNION SELECT fips FROM cases)),
grid AS (SELECT k.fips, x.date, t.alert_type FROM known k CROSS JOIN (SELECT DISTINCT date FROM daily) x
  CROSS JOIN (SELECT DISTINCT alert_type FROM daily) t),
gridded AS (SELECT g.fips, g.date, g.alert_type, d.count FROM grid g LEFT JOIN daily d
  ON g.fips = d.fips AND g.date = d.date AND g.alert_type = d.alert_type)"""

FILLED = f"""{GRID},
filled AS (SELECT fips, date, alert_type,
  CASE WHEN count("count") OVER (PARTITION BY fips, date) > 0 THEN coalesce("count", 0) ELSE "count" END AS count
  FROM gridded)"""

ATTACHED = f"""{FILLED},
attached AS (SELECT f.fips, f.date, f.alert_type, f.count, c.cases, c.deaths
  FROM filled f LEFT JOIN cases c ON f.fips = c.fips AND f.date = c.date)"""

FULL = f"""{ATTACHED},
first_day AS (SELECT min(date) AS d FROM attached WHERE cases IS NOT NULL),
full_panel AS (SELECT a.fips, k.state, k.county, a.date, a.alert_type, a.count,
  CASE WHEN a.date >= d THEN coalesce(a.cases, 0) ELSE a.cases END AS cases,
  CASE WHEN a.date >= d THEN coalesce(a.deaths, 0) ELSE a.deaths END AS deaths
  FROM attached a JOIN known k ON a.fips = k.fips CROSS JOIN first_day)"""

DELINEATION = """delineation AS (SELECT printf('%05d', n_nationkey) AS fips, printf('%05d', n_nationkey) AS cbsa_code,
  CASE WHEN n_nationkey < 20 THEN r_name END AS csa_title,
  CASE WHEN n_nationkey % 3 = 0 THEN 'Micropolitan Statistical Area' ELSE 'Metropolitan Statistical Area' END AS metro_type,
  CASE WHEN n_nationkey % 2 = 0 THEN 'Central' ELSE 'Outlying' END AS central_outlying
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

HOURLY = """hourly AS (SELECT event_id, user_id, printf('%05d', user_id) AS geoid, CAST(ts AS DATE) AS date,
  CAST(hour(ts) AS INTEGER) AS hour, ts, event_type AS sub_type, CAST(floor(value) AS BIGINT) AS count, value
  FROM events)"""


def wide_daily(places: str, source: str = "panel", name: str = "wide") -> str:
    cells = each("max(count) FILTER (WHERE alert_type = '{k}') AS count_{k}")
    return f"{name} AS (SELECT {places}, date, {cells} FROM {source} GROUP BY ALL)"


def match(places: list[str], source: str = "panel") -> str:
    """Wide daily counts with the mean of the same month and weekday a year before."""
    keys = ", ".join(places)
    on = " AND ".join(f"d.{p} = m.{p}" for p in places)
    return f"""{wide_daily(keys, source)},
dated AS (SELECT *, {year('date')} AS year, {month('date')} AS month, {dow('date')} AS dow FROM wide),
means AS (SELECT {keys}, year, month, dow, {each('avg(count_{k}) AS prior_mean_{k}')} FROM dated GROUP BY ALL),
matched AS (SELECT d.*, {each('m.prior_mean_{k}')} FROM dated d LEFT JOIN means m
  ON {on} AND m.year = d.year - 1 AND m.month = d.month AND m.dow = d.dow)"""


def weeks(places: list[str], source: str = "panel", window: tuple[str, str] | None = None) -> str:
    """Weekly sums with the year before and the week before, by self-joins."""
    keys = ", ".join(places)

    def on(alias: str) -> str:
        return " AND ".join(f"c.{p} = {alias}.{p}" for p in places)

    sums = each("CAST(sum(coalesce(count, 0)) FILTER (WHERE alert_type = '{k}') AS BIGINT) AS week_sum_{k}")
    mean = joined = means = ""
    if window:
        mean = ", " + each("b.window_mean_{k}")
        means = f""",
window_means AS (SELECT {keys}, {each('avg(week_sum_{k}) AS window_mean_{k}')} FROM week_sums
  WHERE saturday - 6 >= DATE '{window[0]}' AND saturday <= DATE '{window[1]}' GROUP BY ALL)"""
        joined = f" LEFT JOIN window_means b ON {on('b')}"
    return f"""week_sums AS (SELECT {keys}, {epi_year('date')} AS year, {epi_week('date')} AS week,
  {saturday('date')} AS saturday, CAST(month({saturday('date')} - 6) AS INTEGER) AS month_start, {sums}
  FROM {source} GROUP BY ALL){means},
weekly AS (SELECT c.* EXCLUDE (saturday), {each('p.week_sum_{k} AS prior_year_{k}')},
  {each('l.week_sum_{k} AS prev_week_{k}')}{mean}
  FROM week_sums c LEFT JOIN week_sums p ON {on('p')} AND p.year = c.year - 1 AND p.week = c.week
  LEFT JOIN week_sums l ON {on('l')} AND l.saturday = c.saturday - 7{joined})"""
