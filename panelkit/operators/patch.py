"""Substitute baselines for periods in which the prior year is unusable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.constants import KINDS, MIN_BASELINE
from panelkit.functions import dates, nulls
from panelkit.operators.keys import null_safe_join, once
from panelkit.operators.reshape import widen


def _chosen(panel: DataFrame, year: int, months, states) -> DataFrame:
    """Rows of the substitute year; the date range reaches the scan."""
    return panel.where(dates.in_years("date", [year])).withColumns({
        "month": dates.month_text("date"),
        "dow": dates.day_of_week("date"),
        "week": dates.simple_week("date"),
    }).where(F.col("month").isin(list(months)) & F.col("state").isin(list(states)))


def _suppressed_wide(df: DataFrame, keys: list[str], prefix: str, kinds) -> DataFrame:
    kept = df.withColumn("value", nulls.null_below("value", MIN_BASELINE))
    return widen(kept, keys, "alert_type", {prefix: "value"}, kinds)


def substitute_profile_state(panel: DataFrame, year: int, months, states, kinds=KINDS) -> DataFrame:
    """Mean per place, summed over the places of a state, by month and weekday."""
    by_place = _chosen(panel, year, months, states).groupBy(
        "fips", "alert_type", "state", "month", "dow"
    ).agg(F.avg("count").alias("mean"))
    by_state = by_place.groupBy("alert_type", "state", "month", "dow").agg(
        nulls.sum_or_zero("mean").alias("value")
    )
    return _suppressed_wide(by_state, ["state", "month", "dow"], "substitute", kinds)


def substitute_profile_county(panel: DataFrame, year: int, months, states, kinds=KINDS) -> DataFrame:
    """Mean per place by month and weekday."""
    means = _chosen(panel, year, months, states).groupBy(
        "fips", "alert_type", "state", "month", "dow"
    ).agg(F.avg("count").alias("value"))
    return _suppressed_wide(means, ["fips", "state", "month", "dow"], "substitute", kinds)


def substitute_week_sums(panel: DataFrame, year: int, months, states, kinds=KINDS) -> DataFrame:
    """Weekly sums per place."""
    sums = _chosen(panel, year, months, states).groupBy(
        "fips", "alert_type", "state", "week"
    ).agg(nulls.sum_or_zero("count").alias("value"))
    return _suppressed_wide(sums, ["fips", "state", "week"], "substitute", kinds)


def apply_patch(
    target: DataFrame, patch: DataFrame, keys: list[str], states, prefix: str, kinds=KINDS
) -> DataFrame:
    """The substitute in place of the baseline where there is one, in listed
    states only. Rows and columns of the target stay as they are; a repeated key
    of the patch is an error."""
    in_scope = F.col("state").isin(list(states))
    new = {
        f"{prefix}_{k}": F.when(in_scope, F.coalesce(f"substitute_{k}", f"{prefix}_{k}"))
        .otherwise(F.col(f"{prefix}_{k}"))
        for k in kinds
    }
    return null_safe_join(target, once(patch, keys), keys).withColumns(new).select(*target.columns)
