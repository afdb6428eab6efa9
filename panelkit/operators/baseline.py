"""Baselines, impact indices against them, and suppression of small numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.constants import KINDS, MIN_BASELINE, OUTLIER_CAP, ZERO_BELOW
from panelkit.functions import dates, nulls
from panelkit.operators.keys import null_safe_join
from panelkit.operators.reshape import widen

PLACE = ["fips", "state", "county"]
IMPACT_NAMES = dict(zip(KINDS, ("impact_crash", "impact_jam", "impact_weh")))


def _statistics(value: str, prefix: str) -> list[Column]:
    """Mean, median and sample deviation to one digit, and rows.

    The median is exact. Its group is one place, kind and weekday (and month),
    so it holds at most one value per week of the period.
    """
    return [
        nulls.rounded(F.avg(value), 1).alias(f"{prefix}_mean"),
        nulls.rounded(F.median(value), 1).alias(f"{prefix}_median"),
        nulls.rounded(F.stddev_samp(value), 1).alias(f"{prefix}_sd"),
        F.count(F.lit(1)).alias(f"{prefix}_n"),
    ]


def historical_profile(panel: DataFrame, before_year: int, value: str = "count") -> DataFrame:
    """Statistics by kind, place, month and weekday over the years before the target."""
    history = panel.where(F.col("date") < F.make_date(F.lit(before_year), F.lit(1), F.lit(1)))
    return (
        history.withColumns({"month": dates.month_text("date"), "day_week": dates.weekday_name("date")})
        .groupBy("alert_type", *PLACE, "month", "day_week")
        .agg(*_statistics(value, "hist"))
    )


def window_baseline(
    panel: DataFrame, start: str, end: str, value: str = "count", prefix: str = "bl"
) -> DataFrame:
    """Statistics by kind, place and weekday within an inclusive window of days."""
    days = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return (
        panel.where(days)
        .withColumn("day_week", dates.weekday_name("date"))
        .groupBy("alert_type", *PLACE, "day_week")
        .agg(*_statistics(value, prefix))
    )


def baseline_rollups(baseline: DataFrame, value: str = "bl_mean") -> DataFrame:
    """Totals of a baseline at four grains in one pass over it."""
    kind, fips, state, county = (F.col(c) for c in ("alert_type", *PLACE))
    grains = [
        [kind, fips, state, county],
        [kind, state],
        [fips, state, county],
        [state],
    ]
    grain = (
        F.when((F.grouping("alert_type") == 0) & (F.grouping("fips") == 0), "place and kind")
        .when(F.grouping("alert_type") == 0, "state and kind")
        .when(F.grouping("fips") == 0, "place")
        .otherwise("state")
    )
    return (
        baseline.groupingSets(grains, kind, fips, state, county)
        .agg(
            grain.alias("grain"),
            nulls.rounded(nulls.sum_or_zero(value), 1).alias("bl_sum"),
            F.count(F.lit(1)).alias("bl_n"),
        )
    )


def observed_vs_predicted_wide(
    pred: DataFrame, keys: list[str], kinds=KINDS, observed: str = "count", predicted: str = "pred_count"
) -> DataFrame:
    """One row per place and day with observed and predicted columns per kind."""
    return widen(pred, keys, "alert_type", {"count": observed, "pred_count": predicted}, kinds)


def impact_index(
    wide: DataFrame, suffix: str = "", predicted=lambda k: F.col(f"pred_count_{k}"), kinds=KINDS
) -> DataFrame:
    """Relative change from expected per kind, and the strict mean over kinds.

    A change is NULL when either side is unknown or no finite number, or the
    expectation is 0, and the index is NULL when any of the changes is.
    """
    changes = {
        f"{IMPACT_NAMES[k]}{suffix}": nulls.finite(nulls.relative_change(f"count_{k}", predicted(k)))
        for k in kinds
    }
    index = nulls.row_sum(*changes) / len(kinds)
    return wide.withColumns(changes).withColumn(f"impact_index{suffix}", index)


def join_baselines(wide: DataFrame, history: DataFrame, window: DataFrame, kinds=KINDS) -> DataFrame:
    """Attach both baselines, made wide, to a wide table of one row per place-day.

    Place names may be unknown on both sides, so the keys match NULL to NULL.
    """
    hist_wide = widen(
        history, [*PLACE, "month", "day_week"], "alert_type",
        {c: c for c in ("hist_mean", "hist_median", "hist_sd", "hist_n")}, kinds,
    )
    window_wide = widen(
        window, [*PLACE, "day_week"], "alert_type",
        {c: c for c in ("bl_mean", "bl_median", "bl_sd", "bl_n")}, kinds,
    )
    keyed = wide.withColumns(
        {"month": dates.month_text("date"), "day_week": dates.weekday_name("date")}
    )
    with_history = null_safe_join(keyed, hist_wide, [*PLACE, "month", "day_week"])
    return null_safe_join(with_history, window_wide, [*PLACE, "day_week"])


def null_outliers(df: DataFrame, column: str = "count_WEATHERHAZARD", cap=OUTLIER_CAP) -> DataFrame:
    return df.withColumn(column, nulls.null_above(column, cap))


def threshold_predictions(df: DataFrame, zero_below=ZERO_BELOW, prefix: str = "pred_count_") -> DataFrame:
    """Predictions under their kind's threshold become 0; NULL stays NULL."""
    return df.withColumns({
        f"{prefix}{k}": F.when(F.col(f"{prefix}{k}") < least, F.lit(0.0)).otherwise(F.col(f"{prefix}{k}"))
        for k, least in zero_below.items()
    })


def impact_thresholded(wide: DataFrame, zero_below=ZERO_BELOW) -> DataFrame:
    """The index on thresholded predictions."""
    return impact_index(threshold_predictions(wide, zero_below), "_th")


def impact_rounded(wide: DataFrame) -> DataFrame:
    """The index on predictions rounded to whole events."""
    return impact_index(wide, "_rnd", lambda k: nulls.rounded(f"pred_count_{k}", 0))


def suppress_small_totals(
    df: DataFrame, prefix: str, min_total=MIN_BASELINE, kinds=KINDS
) -> DataFrame:
    """NULL for all kinds of a row whose total is too small.

    The unsuppressed values stay as ``*_nf`` next to ``<prefix>_total``. An
    unknown total suppresses nothing.
    """
    columns = [f"{prefix}_{k}" for k in kinds]
    total = f"{prefix}_total"
    kept = df.withColumns({f"{c}_nf": F.col(c) for c in columns}).withColumn(
        total, nulls.row_sum(*columns)
    )
    small = F.coalesce(F.col(total) < min_total, F.lit(False))
    return kept.withColumns({c: F.when(~small, F.col(c)) for c in columns})


def sufficient_rows(df: DataFrame, by: list[str], total: str, min_total=MIN_BASELINE) -> DataFrame:
    """Rows per group whose total is not too small."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count_if(F.col(total) < min_total)).alias("n_sufficient"),
    )


def suppress_small_cells(df: DataFrame, columns: list[str], least=MIN_BASELINE) -> DataFrame:
    """NULL for every cell under the minimum."""
    return df.withColumns({c: nulls.null_below(c, least) for c in columns})


def high_value_rows(
    df: DataFrame, column: str, cap, low: tuple[str, float] | None = None
) -> DataFrame:
    """Rows above a cap, optionally only those with a low value in another column."""
    chosen = df.where(F.col(column) > cap)
    return chosen if low is None else chosen.where(F.col(low[0]) < low[1])


def state_day_summary(wide: DataFrame) -> DataFrame:
    """Cases, deaths and median index per day and state.

    The median's group is one value per place of a state on one day.
    """
    return wide.groupBy("date", "state").agg(
        nulls.sum_or_zero("cases").alias("sum_cases"),
        nulls.sum_or_zero("deaths").alias("sum_deaths"),
        F.median("impact_index").alias("median_impact_index"),
    )
