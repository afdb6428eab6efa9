"""Queries on the generic operators: sources, keys, aggregates, scalars."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from panelkit.constants import KINDS, PAIR
from panelkit.functions import dates, nulls, text
from panelkit.operators import keys
from panelkit.operators.reshape import lengthen, widen
from panelkit.plans import sql, stand_ins as data
from panelkit.plans.registry import query
from panelkit.plans.sql import with_
from panelkit.session import shared_path, stage
from panelkit.sources import readers, schemas, writers

# Sources and sinks: written to the shared folder and read back.

CELLS = with_(sql.PANEL, "SELECT * FROM panel")
PANEL_COLUMNS = ["fips", "state", "county", "date", "alert_type", "count"]
PANEL_SCHEMA = "fips string, state string, county string, date date, alert_type string, count long"


@query("csv_table", CELLS)
def csv_table(spark, d):
    path = shared_path(spark, "csv")
    writers.write_csv(data.panel(spark, d), path)
    return readers.read_csv(spark, path, PANEL_SCHEMA)


@query("csv_type_overrides", with_(sql.PANEL, "SELECT * REPLACE (CAST(count AS DOUBLE) AS count) FROM panel"))
def csv_type_overrides(spark, d):
    path = shared_path(spark, "csv")
    writers.write_csv(data.panel(spark, d), path)
    return readers.read_csv(spark, path, schemas.with_types(PANEL_COLUMNS, count="double", date="date"))


@query("delimited_table", with_(sql.PANEL,
       "SELECT fips AS place, date AS day, alert_type AS kind, nullif(count, 1) AS n FROM panel"))
def delimited_table(spark, d):
    path = shared_path(spark, "delimited")
    cells = data.panel(spark, d).select(
        "fips", "date", "alert_type", F.nullif("count", F.lit(1)).alias("count")
    )
    cells.write.option("sep", ";").option("nullValue", "...").option("header", True).csv(path)
    return readers.read_delimited(spark, path, "place string, day date, kind string, n long")


@query("reference_sheet", """SELECT o_custkey AS Cust_Code, CAST(o_orderdate AS DATE) AS Order_Date FROM orders
  WHERE o_orderpriority <> '5-LOW'""")
def reference_sheet(spark, d):
    path = shared_path(spark, "sheet")
    code = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))
    sheet = data.table(spark, d, "orders").select(
        code.alias("Cust Code"), F.to_date("o_orderdate").alias("Order Date")
    )
    writers.write_csv(sheet, path)
    schema = "`Cust Code` long, `Order Date` date"
    return readers.read_reference(spark, path, schema, "Cust_Code")


@query("latest_snapshot", with_(sql.PANEL, """SELECT * EXCLUDE (count), count + 1 AS count,
  DATE '2001-02-01' AS snapshot_date FROM panel"""))
def latest_snapshot(spark, d):
    base, panel = shared_path(spark, "snapshots"), data.staged_panel(spark, d)
    writers.write_snapshot(panel, base, "panel", "2001-01-01")
    writers.write_snapshot(panel.withColumn("count", F.col("count") + 1), base, "panel", "2001-02-01")
    return readers.read_snapshot(spark, base, "panel")


@query("dated_snapshot", with_(sql.PANEL, "SELECT *, DATE '2001-01-01' AS snapshot_date FROM panel"))
def dated_snapshot(spark, d):
    base, panel = shared_path(spark, "snapshots"), data.staged_panel(spark, d)
    writers.write_snapshot(panel, base, "panel", "2001-01-01")
    writers.write_snapshot(panel.withColumn("count", F.col("count") + 1), base, "panel", "2001-02-01")
    return readers.read_snapshot(spark, base, "panel", "2001-01-01")


@query("prediction_table", CELLS)
def prediction_table(spark, d):
    path = shared_path(spark, "predictions")
    writers.write_predictions(data.panel(spark, d), path)
    return readers.read_table(spark, path).select(*PANEL_COLUMNS)


@query("model_files", with_(sql.PANEL, """SELECT fips, date, count,
  CASE alert_type WHEN 'ACCIDENT' THEN 'crash' WHEN 'JAM' THEN 'jam' ELSE 'weh' END AS model FROM panel"""))
def model_files(spark, d):
    """A folder of files per model, read as one table; the file name is the model."""
    base, panel = shared_path(spark, "models"), data.staged_panel(spark, d)
    short = {"ACCIDENT": "crash", "JAM": "jam", "WEATHERHAZARD": "weh"}
    for kind, name in short.items():
        rows = panel.where(F.col("alert_type") == kind).select("fips", "date", "count")
        writers.write_csv(rows, f"{base}/{name}_forest_pred.csv")
    return readers.read_models(spark, f"{base}/*_pred.csv", "fips string, date date, count long")


@query("report_log", with_(sql.PANEL, """SELECT state, alert_type || ', "' || alert_type || '"' AS label,
  CAST(sum(count) AS BIGINT) AS total FROM panel GROUP BY state, alert_type
  UNION ALL SELECT state, 'all', CAST(sum(count) AS BIGINT) FROM panel GROUP BY state"""))
def report_log(spark, d):
    """Two reports appended to one log without a header."""
    path, panel = shared_path(spark, "log"), data.staged_panel(spark, d)
    label = F.format_string('%s, "%s"', "alert_type", "alert_type").alias("label")
    total = F.sum("count").alias("total")
    writers.append_log(panel.groupBy("state", "alert_type").agg(total).select("state", label, "total"), path)
    writers.append_log(panel.groupBy("state").agg(total).select("state", F.lit("all"), "total"), path)
    return spark.read.schema("state string, label string, total long").option("escape", '"').csv(path)


EXISTS = """SELECT user_id, count(*) AS n FROM {events} e WHERE EXISTS (SELECT 1 FROM {events} x
  WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 30) GROUP BY user_id"""


@query("sql_exists", EXISTS.replace("{events}", "events"))
def sql_exists(spark, d):
    return readers.read_sql(spark, EXISTS, events=data.table(spark, d, "events"))


@query("up_to_lag", with_(sql.PANEL, "SELECT * FROM panel WHERE date <= (SELECT max(date) FROM panel) - 3"))
def up_to_lag(spark, d):
    panel = data.staged_panel(spark, d)
    return readers.up_to(panel, panel.agg(F.max("date")).scalar(), 3)


# Filters and keys.


@query("excluded_values", """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders
  WHERE nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def excluded_values(spark, d):
    rows = data.table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")
    )
    return rows.where(nulls.excluded("p", ["1-URGENT", "2-HIGH"]))


@query("pattern_filters", """SELECT user_id, count(*) AS n FROM events
  WHERE (event_type LIKE 'c%' OR regexp_matches(event_type, '^(view|err)')) AND contains(props, '"k": 1') GROUP BY user_id""")
def pattern_filters(spark, d):
    kind = F.col("event_type")
    wanted = (kind.startswith("c") | kind.rlike("^(view|err)")) & F.col("props").contains('"k": 1')
    return data.table(spark, d, "events").where(wanted).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("first_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_per_key(spark, d):
    orders = data.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return keys.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("repeated_keys", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return keys.repeated_keys(data.table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"])


@query("key_difference", """SELECT coalesce(c, o) AS custkey, CASE WHEN r IS NULL THEN 'left' ELSE 'right' END AS only_in
  FROM (SELECT nullif(c_custkey, 1) AS c, true AS l FROM customer) FULL JOIN
  (SELECT DISTINCT CASE WHEN o_orderdate >= TIMESTAMP '2000-06-01' THEN o_custkey END AS o, true AS r FROM orders) ON c IS NOT DISTINCT FROM o
  WHERE l IS NULL OR r IS NULL""")
def key_difference(spark, d):
    """Unknown keys on both sides are one and the same key."""
    customers = data.table(spark, d, "customer").select(F.nullif("c_custkey", F.lit(1)).alias("custkey"))
    recent = F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp")
    ordering = data.table(spark, d, "orders").select(F.when(recent, F.col("o_custkey")).alias("custkey"))
    return keys.key_difference(customers, ordering, ["custkey"])


@query("natural_join", with_(sql.PANEL, sql.CASES, """SELECT p.* REPLACE (nullif(p.fips, '00003') AS fips), c.cases, c.deaths FROM panel p
  LEFT JOIN cases c ON nullif(c.fips, '00003') IS NOT DISTINCT FROM nullif(p.fips, '00003') AND c.date = p.date"""))
def natural_join(spark, d):
    """One place has no code on either side."""
    unknown = {"fips": F.nullif("fips", F.lit("00003"))}
    return keys.natural_join(data.panel(spark, d).withColumns(unknown), data.cases(spark, d).withColumns(unknown))


@query("natural_full_join", with_(sql.PANEL, sql.CASES, """daily_totals AS (SELECT fips, date, CAST(sum(count) AS BIGINT) AS total
  FROM panel GROUP BY ALL)""", """SELECT nullif(coalesce(t.fips, c.fips), '00003') AS fips, coalesce(t.date, c.date) AS date, total, cases, deaths
  FROM daily_totals t FULL JOIN cases c ON t.fips = c.fips AND t.date = c.date"""))
def natural_full_join(spark, d):
    """One place has no code on either side."""
    unknown = {"fips": F.nullif("fips", F.lit("00003"))}
    totals = data.panel(spark, d).groupBy("fips", "date").agg(F.sum("count").alias("total"))
    return keys.natural_join(totals.withColumns(unknown), data.cases(spark, d).withColumns(unknown), "full_outer")


@query("null_safe_join", """WITH a AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag FROM lineitem),
  b AS (SELECT nullif(l_returnflag, 'N') AS flag, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT a.*, b.n FROM a LEFT JOIN b ON a.flag IS NOT DISTINCT FROM b.flag""")
def null_safe_join(spark, d):
    rows = data.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag")
    )
    counts = rows.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return keys.null_safe_join(rows, counts, ["flag"])


@query("extreme_rows", with_(sql.PANEL, "known AS (SELECT * REPLACE (nullif(state, 'ASIA') AS state) FROM panel)",
       "SELECT * FROM known QUALIFY count = max(count) OVER (PARTITION BY state, alert_type)"))
def extreme_rows(spark, d):
    known = data.staged_panel(spark, d).withColumn("state", F.nullif("state", F.lit("ASIA")))
    return keys.extreme_rows(known, ["state", "alert_type"], "count")


@query("last_week_of_year", f"""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
  w AS (SELECT DISTINCT {sql.epi_year('date')} AS year, {sql.epi_week('date')} AS week FROM d)
  SELECT * FROM w WHERE week = (SELECT max(week) FROM w x WHERE x.year = w.year)""")
def last_week_of_year(spark, d):
    days = data.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    weeks = days.select(dates.epi_year("date").alias("year"), dates.epi_week("date").alias("week")).distinct()
    return keys.extreme_rows(stage(weeks, "weeks"), ["year"], "week")


@query("last_days", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem ORDER BY date DESC LIMIT 10")
def last_days(spark, d):
    days = data.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return keys.last_n(days, "date", 10)


@query("sorted_panel", with_(sql.PANEL, "SELECT * FROM panel ORDER BY date, fips, alert_type"))
def sorted_panel(spark, d):
    return data.panel(spark, d).orderBy("date", "fips", "alert_type")


@query("split_and_append", with_(sql.PANEL, """SELECT * REPLACE (CASE WHEN state IN ('AFRICA', 'ASIA') THEN count * 2
  ELSE count END AS count) FROM panel"""))
def split_and_append(spark, d):
    doubled = lambda rows: rows.withColumn("count", F.col("count") * 2)
    return keys.split_and_append(
        data.panel(spark, d), F.col("state").isin(*data.PATCH_STATES), doubled
    )


# Aggregates and reshaping.


@query("null_rules", """SELECT l_orderkey, CASE WHEN count(q) = count(*) THEN CAST(sum(q) AS BIGINT) END AS strict_sum,
  CAST(coalesce(sum(q), 0) AS BIGINT) AS present_sum, count(*) AS n, count(*) - count(q) AS n_null,
  count(*) FILTER (WHERE q > 40) AS n_high, min(q) AS lowest, max(q) AS highest,
  bool_or(q IS NOT NULL) AS any_known, bool_and(q IS NOT NULL) AS all_known, count(DISTINCT q) AS n_distinct
  FROM (SELECT l_orderkey, CAST(nullif(l_quantity, 50) AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey""")
def null_rules(spark, d):
    rows = data.table(spark, d, "lineitem").select(
        "l_orderkey", F.nullif("l_quantity", F.lit(50)).cast("long").alias("q")
    )
    known = F.col("q").isNotNull()
    return rows.groupBy("l_orderkey").agg(
        nulls.strict_sum("q").alias("strict_sum"), nulls.sum_or_zero("q").alias("present_sum"),
        F.count(F.lit(1)).alias("n"), nulls.null_count("q").alias("n_null"),
        F.count_if(F.col("q") > 40).alias("n_high"), F.min("q").alias("lowest"), F.max("q").alias("highest"),
        F.bool_or(known).alias("any_known"), F.bool_and(known).alias("all_known"),
        F.count_distinct("q").alias("n_distinct"),
    )


@query("weighted_mean", """SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE w IS NULL OR (w <> 0 AND x IS NULL)) > 0 THEN NULL
  ELSE round(sum(CASE WHEN w <> 0 THEN x * w END) / nullif(sum(w), 0), 6) END AS mean
  FROM (SELECT l_orderkey, CAST(nullif(l_quantity, 50) AS DOUBLE) AS x,
    CASE WHEN l_quantity >= 49 AND l_discount > 0.05 THEN 0.0 ELSE l_extendedprice END AS w FROM lineitem) GROUP BY l_orderkey""")
def weighted_mean(spark, d):
    quantity = F.col("l_quantity")
    weight = F.when((quantity >= 49) & (F.col("l_discount") > 0.05), F.lit(0.0))
    rows = data.table(spark, d, "lineitem").select(
        "l_orderkey", F.nullif(quantity, F.lit(50)).cast("double").alias("x"),
        weight.otherwise(F.col("l_extendedprice")).alias("w"),
    )
    return data.shown(rows.groupBy("l_orderkey").agg(nulls.weighted_mean("x", "w").alias("mean")), "mean")


@query("row_sums", with_(sql.PANEL, sql.wide_daily("fips"), f"""SELECT fips, date, {' + '.join(f'count_{k}' for k in KINDS)} AS strict_total,
  {' + '.join(f'coalesce(count_{k}, 0)' for k in KINDS)} AS present_total FROM wide"""))
def row_sums(spark, d):
    columns = [f"count_{k}" for k in KINDS]
    wide = widen(data.panel(spark, d), ["fips", "date"], "alert_type", {"count": "count"}, KINDS)
    return wide.select("fips", "date", nulls.row_sum(*columns).alias("strict_total"),
                       nulls.row_sum_present(*columns).alias("present_total"))


@query("long_again", with_(sql.PANEL, sql.wide_daily("fips"), " UNION ALL ".join(
       f"SELECT fips, date, '{k}' AS alert_type, count_{k} AS count FROM wide" for k in KINDS)))
def long_again(spark, d):
    wide = widen(data.panel(spark, d), ["fips", "date"], "alert_type", {"count": "count"}, KINDS)
    return lengthen(wide, ["fips", "date"], "alert_type", {"count": "count"}, KINDS)


@query("category_index", """SELECT o_orderkey, o_orderpriority, CAST(i AS DOUBLE) AS priority_index FROM orders JOIN (
  SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS i FROM orders GROUP BY 1)
  USING (o_orderpriority)""")
def category_index(spark, d):
    orders = data.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return StringIndexer(inputCol="o_orderpriority", outputCol="priority_index").fit(orders).transform(orders)


# Scalars.


@query("text_functions", f"""SELECT o_orderkey, printf('%05d', o_custkey) AS padded, printf('%02d', o_custkey) AS padded_narrow,
  substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS ym, split_part(o_orderpriority, '-', 1) AS code,
  nullif(regexp_extract(o_orderstatus || ',' || o_orderpriority, '{PAIR}', 2), '') AS second_half,
  nullif(regexp_extract(o_orderpriority, '{PAIR}', 1), '') AS no_pair,
  concat_ws(' ', o_orderstatus, nullif(o_orderpriority, '5-LOW')) AS label,
  CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'now' ELSE 'later' END AS class FROM orders""")
def text_functions(spark, d):
    priority = F.col("o_orderpriority")
    return data.table(spark, d, "orders").select(
        "o_orderkey", text.padded("o_custkey", 5).alias("padded"), text.padded("o_custkey", 2).alias("padded_narrow"),
        dates.year_month("o_orderdate").alias("ym"), text.split_part("o_orderpriority", "-", 0).alias("code"),
        text.split_pair(F.concat_ws(",", "o_orderstatus", "o_orderpriority"))[1].alias("second_half"),
        text.split_pair("o_orderpriority")[0].alias("no_pair"),
        F.concat_ws(" ", "o_orderstatus", F.nullif(priority, F.lit("5-LOW"))).alias("label"),
        F.when(priority.contains("URGENT"), "now").otherwise("later").alias("class"),
    )


@query("date_functions", f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
  SELECT o_orderkey, CAST(dayofyear(d) AS INTEGER) AS day_of_year, CAST(day(d) AS INTEGER) AS day_of_month,
  CAST(day(last_day(d)) AS INTEGER) AS days_in_month, d AS rebuilt, date_trunc('month', d)::DATE AS parsed_month,
  {sql.saturday('d')} AS week_ending, CAST(date_trunc('month', d) AS DATE) AS month_start, d - 3 AS lagged FROM o""")
def date_functions(spark, d):
    day = F.to_date("o_orderdate")
    return data.table(spark, d, "orders").select(
        "o_orderkey", F.dayofyear(day).alias("day_of_year"), F.dayofmonth(day).alias("day_of_month"),
        dates.days_in_month(day).alias("days_in_month"),
        dates.date_from_year_day(F.year(day), F.dayofyear(day)).alias("rebuilt"),
        dates.parse_month(F.date_format(day, "MMM yyyy")).alias("parsed_month"),
        dates.week_ending(day).alias("week_ending"), dates.month_start(day).alias("month_start"),
        F.date_sub(day, 3).alias("lagged"),
    )


@query("number_functions", f"""SELECT l_orderkey, l_linenumber, {sql.rounded('l_extendedprice * l_discount', 1)} AS rounded,
  (l_extendedprice - 1000) / nullif(l_discount, 0) AS change, CAST(floor(l_extendedprice) AS BIGINT) AS whole,
  round(ln(l_extendedprice), 6) AS log, sqrt(l_extendedprice) AS root, abs(l_quantity - 25) AS distance,
  CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS bucket,
  TRY_CAST(l_returnflag || l_linenumber AS INTEGER) AS not_a_number,
  CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS capped, CASE WHEN l_quantity >= 10 THEN l_quantity END AS floored
  FROM lineitem""")
def number_functions(spark, d):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return data.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", nulls.rounded(price * discount, 1).alias("rounded"),
        nulls.ratio(price - 1000, discount).alias("change"), F.floor(price).cast("long").alias("whole"),
        F.round(F.ln(price), 6).alias("log"), F.sqrt(price).alias("root"),
        F.abs(F.col("l_quantity") - 25).alias("distance"),
        F.when(discount > 0.05, "high").otherwise("low").alias("bucket"),
        F.concat("l_returnflag", F.col("l_linenumber").cast("string")).try_cast("int").alias("not_a_number"),
        nulls.null_above("l_quantity", 40).alias("capped"), nulls.null_below("l_quantity", 10).alias("floored"),
    )
