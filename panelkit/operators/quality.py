"""Data-quality checks on panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.constants import JUMPS_PERCENT, KINDS, MAX_JUMP_DAYS, USABLE_COUNT, USABLE_SHARE
from panelkit.functions import nulls
from panelkit.operators.compare import SHORT
from panelkit.operators.keys import null_safe_join
from panelkit.operators.ranks import frequencies, quantiles_of
from panelkit.session import stage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def date_completeness(wide: DataFrame, kinds=KINDS, date: str = "date") -> DataFrame:
    """Total count and missing cells per date."""
    columns = [f"count_{k}" for k in kinds]
    return wide.groupBy(date).agg(
        nulls.row_sum(*[nulls.sum_or_zero(c) for c in columns]).alias("total_count"),
        nulls.row_sum(*[nulls.null_count(c) for c in columns]).alias("null_cells"),
    )


def null_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values per column in one pass."""
    return df.agg(*[nulls.null_count(c).alias(c) for c in columns])


def metro_day(wide: DataFrame, metro: str, kinds=KINDS) -> DataFrame:
    """One row per metro area and day, which a day-to-day comparison needs."""
    return wide.groupBy(metro, "date").agg(
        *[nulls.sum_or_zero(f"count_{k}").alias(f"count_{k}") for k in kinds]
    )


def day_over_day_change(
    metro_days: DataFrame, metro: str, kinds=KINDS, relative_to: str = "current"
) -> DataFrame:
    """Change from the row of the day before, per kind, and the mean change.

    The base is the current value unless ``relative_to`` is ``"previous"``. A
    change against a base of zero has no finite ratio; it is reported in
    ``infinite_change`` instead. The window holds one metro area's days.
    """
    by_metro = W.partitionBy(metro).orderBy("date")
    df = metro_days.withColumns({f"_prev_{k}": F.lag(f"count_{k}").over(by_metro) for k in kinds})
    base = {k: F.col(f"count_{k}" if relative_to == "current" else f"_prev_{k}") for k in kinds}
    difference = {k: F.col(f"count_{k}") - F.col(f"_prev_{k}") for k in kinds}
    df = df.withColumns({f"change_{SHORT[k]}": nulls.ratio(difference[k], base[k]) for k in kinds})
    infinite = F.lit(False)
    for k in kinds:
        infinite = infinite | F.coalesce((base[k] == 0) & (difference[k] != 0), F.lit(False))
    mean = nulls.row_sum_present(*[f"change_{SHORT[k]}" for k in kinds]) / len(kinds)
    return df.withColumns({"mean_change": mean, "infinite_change": infinite}).drop(
        *[f"_prev_{k}" for k in kinds]
    )


def volatility_by_metro(changes: DataFrame, metro: str) -> DataFrame:
    """Days per metro area with a mean change above each threshold."""
    def jumps(percent):
        return F.count_if(F.col("infinite_change") | (F.abs("mean_change") > percent / 100))

    return changes.groupBy(metro).agg(*[jumps(p).alias(f"n_change_{p}") for p in JUMPS_PERCENT])


def volatility_flags(changes: DataFrame, metro: str) -> DataFrame:
    """Metro areas with more than ten such days, per threshold, and all of them."""
    return volatility_by_metro(changes, metro).agg(
        *[
            F.count_if(F.col(f"n_change_{p}") > MAX_JUMP_DAYS).alias(f"n_metros_{p}")
            for p in JUMPS_PERCENT
        ],
        F.count(F.lit(1)).alias("n_metros"),
    )


def suppression_effect(df: DataFrame, by: str, prefix: str, kinds=KINDS) -> DataFrame:
    """Missing values per group, suppressed and unsuppressed."""
    return df.groupBy(by).agg(
        *[nulls.null_count(f"{prefix}_{k}").alias(f"null_{SHORT[k]}") for k in kinds],
        *[nulls.null_count(f"{prefix}_{k}_nf").alias(f"null_{SHORT[k]}_nf") for k in kinds],
    )


def national_reconcile(weekly: DataFrame, daily: DataFrame, kinds=KINDS) -> DataFrame:
    """Weekly totals against the daily totals of the same week.

    ``daily`` carries ``year`` and ``week``; both sides are summed to the week
    before they meet, so the join is one row to one row.
    """
    def total(df, prefix, name):
        parts = nulls.row_sum(*[nulls.sum_or_zero(f"{prefix}_{k}") for k in kinds])
        return df.groupBy("year", "week").agg(parts.alias(name))

    both = total(weekly, "week_sum", "total_weekly").join(
        total(daily, "count", "total_daily"), ["year", "week"], "left"
    )
    return both.withColumn("pct_change", nulls.relative_change("total_weekly", "total_daily"))


def usable_counties(
    wide: DataFrame, place: str = "fips", least=USABLE_COUNT, share=USABLE_SHARE, kinds=KINDS
) -> DataFrame:
    """Places where enough days have a usable count, per kind and for all kinds."""
    counted = wide.groupBy(place).agg(
        F.count(F.lit(1)).alias("n_days"),
        *[F.count_if(F.col(f"count_{k}") > least).alias(f"good_{SHORT[k]}") for k in kinds],
    )
    enough = {
        f"enough_{SHORT[k]}": F.col(f"good_{SHORT[k]}") / F.col("n_days") > share for k in kinds
    }
    all_kinds = F.lit(True)
    for name in enough:
        all_kinds = all_kinds & F.col(name)
    return counted.withColumns(enough).withColumn("mostly_good", all_kinds)


def histogram_log(df: DataFrame, column: str, by: list[str], bins_per_decade: int = 5) -> DataFrame:
    """Rows per log-scale bin; values without a logarithm are left out."""
    bin_no = F.floor(F.log10(column) * bins_per_decade).cast("int")
    return (
        df.where(F.col(column) > 0)
        .groupBy(*by, bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def box_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and outliers per group.

    The table is read once, into frequencies; everything else follows from them.
    A NULL key is a group.
    """
    counted = stage(frequencies(df, by, column), "frequencies")
    quartiles = quantiles_of(counted, by, QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        null_safe_join(counted.where("value is not null"), quartiles, by, "inner")
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing values of a column, all from its frequencies."""
    counted = stage(frequencies(df, [], column), "frequencies")
    value, n = F.col("value"), F.col("n")
    basic = counted.agg(F.struct(
        F.min(value).alias("min"), nulls.ratio(F.sum(value * n), F.sum(F.when(value.isNotNull(), n))).alias("mean"),
        F.max(value).alias("max"), F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("n_null"),
    )).scalar()
    quartiles = quantiles_of(counted, [], QUARTILES)
    return quartiles.withColumn("_b", basic).select(
        "_b.min", "q1", "median", "_b.mean", "q3", "_b.max", "_b.n_null"
    )


def pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def gap_report(series: DataFrame, by: list[str], period: str, value: str) -> DataFrame:
    """Missing months between the first and the last of each series, and NULL values.

    Each row is compared with the one before it; only real gaps are expanded.
    """
    before = F.lag(period).over(W.partitionBy(*by).orderBy(period))
    step = F.expr("INTERVAL 1 MONTH")
    missing = (
        series.withColumn("_before", before)
        .where(F.col(period) > F.add_months("_before", 1))
        .select(*by, F.explode(F.sequence(
            F.add_months("_before", 1), F.add_months(period, -1), step)).alias(period))
        .withColumn("gap", F.lit("missing"))
    )
    unknown = series.where(F.col(value).isNull()).select(*by, period).withColumn("gap", F.lit("null"))
    return missing.unionByName(unknown)
