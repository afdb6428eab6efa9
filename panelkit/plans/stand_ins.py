"""The driver's tables in the shape of the operators' inputs.

Suppliers stand for reporting places: a nation is a county and a region a
state; shipped quantity by day and return flag stands for event counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.text import padded
from panelkit.operators.panel import weekly_panel
from panelkit.session import stage

TARGET_YEAR = 2000
WINDOW = ("2000-01-02", "2000-02-05")
PATCH_STATES = ("AFRICA", "ASIA")
PATCH_MONTHS = ("05", "06")
PATCH_YEAR = 1998
HIGH_COUNT = 150
KIND_OF_FLAG = {"A": "ACCIDENT", "N": "JAM", "R": "WEATHERHAZARD"}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind(flag: str = "l_returnflag") -> Column:
    named = None
    for code, name in KIND_OF_FLAG.items():
        named = F.when(F.col(flag) == code, name) if named is None else named.when(F.col(flag) == code, name)
    return named


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        "n_nationkey", padded("n_nationkey", 5).alias("fips"), F.col("r_name").alias("state"),
        F.col("n_name").alias("county"),
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d).drop("n_nationkey")


def raw_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per shipped line, its place as two code parts."""
    code = padded("s_nationkey", 5)
    supplier = table(spark, d, "supplier").select(
        "s_suppkey", F.substring(code, 1, 2).alias("state_part"), F.substring(code, 3, 3).alias("county_part")
    )
    return table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "state_part", "county_part", F.to_date("l_shipdate").alias("date"),
        kind().alias("alert_type"), F.col("l_quantity").cast("long").alias("count"),
    )


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Counts per nation key, day and flag; names are attached to the few results."""
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return (
        table(spark, d, "lineitem")
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.to_date("l_shipdate").alias("date"), "l_returnflag")
        .agg(F.sum("l_quantity").cast("long").alias("count"))
    )


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Counts per place, day and kind."""
    codes = table(spark, d, "nation").select("n_nationkey", padded("n_nationkey", 5).alias("fips"))
    cells = _cells(spark, d).join(codes, F.col("s_nationkey") == F.col("n_nationkey"))
    return cells.select("fips", "date", kind().alias("alert_type"), "count")


def staged_daily(spark: SparkSession, d: str) -> DataFrame:
    return stage(daily(spark, d), "daily")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts with place names, only the cells that occur."""
    named = _cells(spark, d).join(_nations(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("fips", "state", "county", "date", kind().alias("alert_type"), "count")


def staged_panel(spark: SparkSession, d: str) -> DataFrame:
    return stage(panel(spark, d), "panel")


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders stand for cases, finished ones of them for deaths; unknown before reporting began."""
    orders = table(spark, d, "orders")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    counted = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.to_date("o_orderdate").alias("date"))
        .agg(F.count_if(urgent).alias("cases"), F.count_if(urgent & (F.col("o_orderstatus") == "F")).alias("deaths"))
    )
    begun = F.col("date") >= F.lit("1996-06-01").cast("date")
    counted = counted.withColumns({c: F.when(begun, F.col(c)) for c in ("cases", "deaths")})
    codes = table(spark, d, "nation").select("n_nationkey", padded("n_nationkey", 5).alias("fips"))
    return counted.join(codes, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "fips", "date", "cases", "deaths"
    )


def delineation(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        padded(n, 5).alias("fips"), padded(n, 5).alias("cbsa_code"),
        F.when(n < 20, F.col("r_name")).alias("csa_title"),
        F.when(n % 3 == 0, "Micropolitan Statistical Area")
        .otherwise("Metropolitan Statistical Area").alias("metro_type"),
        F.when(n % 2 == 0, "Central").otherwise("Outlying").alias("central_outlying"),
    )


def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Site events; a user stands for a place."""
    return table(spark, d, "events").select(
        "event_id", "user_id", padded("user_id", 5).alias("geoid"),
        F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "ts",
        F.col("event_type").alias("sub_type"), F.floor("value").cast("long").alias("count"), "value",
    )


def state_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Weekly table by state with its comparisons."""
    return weekly_panel(panel(spark, d), ["state"], window=WINDOW)


def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly totals per state and kind, up to the last month that the data cover to its end."""
    months = stage(
        panel(spark, d)
        .groupBy("state", "alert_type", F.trunc("date", "month").alias("period"))
        .agg(F.sum("count").alias("value"), F.max("date").alias("last")),
        "months",
    )
    newest = months.agg(F.max("last")).scalar()
    return months.where(F.last_day("period") <= newest).drop("last")


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; show fewer digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
