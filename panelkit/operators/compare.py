"""Period comparison and reports.

The weekly tables here have one row per state (or metro area) and week, the
result of a rollup; their size follows the calendar and the place list, not the
raw events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.constants import (
    KINDS, MAX_PERCENT_CHANGE, TOP_PERIODS, TROUGH_FROM_WEEK,
)
from panelkit.functions import dates, nulls
from panelkit.operators.keys import assert_same_keys, first_per_key
from panelkit.operators.reshape import name_value_rows, widen

SHORT = {"ACCIDENT": "crash", "JAM": "jam", "WEATHERHAZARD": "weh"}
BASES = {"prev_week": "prev_week", "prior_year": "prior_year", "window_mean": "window"}


def week_share_weights(weekly: DataFrame, kinds=("JAM", "ACCIDENT")) -> DataFrame:
    """Each state's share of the national baseline of its week, per baseline."""
    week = W.partitionBy("year", "week")
    return weekly.withColumns({
        f"weight_{SHORT[k]}_{name}": nulls.ratio(f"{base}_{k}", F.sum(f"{base}_{k}").over(week))
        for base, name in BASES.items()
        for k in kinds
    })


def pct_changes(weekly: DataFrame, kinds=("JAM", "ACCIDENT")) -> DataFrame:
    """Percent change of the week from each baseline."""
    return weekly.withColumns({
        f"pct_{SHORT[k]}_{name}": 100 * nulls.relative_change(f"week_sum_{k}", f"{base}_{k}")
        for base, name in BASES.items()
        for k in kinds
    })


def national_week_index(weekly: DataFrame, kind: str = "JAM") -> DataFrame:
    """National sums and the baseline-weighted mean of the states' changes per week.

    The share window and the aggregate have the same keys, so one shuffle by
    (year, week) serves both.
    """
    short = SHORT[kind]
    weighted = pct_changes(week_share_weights(weekly, (kind,)), (kind,))
    means = [
        nulls.weighted_mean(f"pct_{short}_{name}", f"weight_{short}_{name}").alias(f"pct_{short}_{name}")
        for name in BASES.values()
    ]
    summed = weighted.groupBy("year", "week").agg(
        nulls.sum_or_zero(f"week_sum_{kind}").alias(f"weekly_sum_{short}"),
        nulls.sum_or_zero(f"prior_year_{kind}").alias(f"weekly_prior_{short}"),
        *means,
    )
    change = nulls.ratio(
        100 * (F.col(f"weekly_sum_{short}") - F.col(f"weekly_prior_{short}")), f"weekly_prior_{short}"
    )
    return summed.withColumn(f"change_from_prior_{short}", change)


def week_ending_lookup(days: DataFrame, date: str = "date") -> DataFrame:
    """(year, week) of every complete week among ``days`` -> its last day."""
    return (
        days.groupBy(dates.epi_year(date).alias("year"), dates.epi_week(date).alias("week"))
        .agg(F.max(date).alias("week_ending_date"), F.count_distinct(date).alias("_days"))
        .where("_days = 7")
        .drop("_days")
    )


def _year_week():
    return F.col("year") * 100 + F.col("week")


def trough(weeks: DataFrame, since_year: int, total: str, since_week: int = TROUGH_FROM_WEEK) -> DataFrame:
    """The week with the lowest total from a start week on; the earliest of equals."""
    row = F.struct(F.col(total).alias("lowest_total"), "year", "week")
    lowest = F.min(F.when(F.col(total).isNotNull(), row)).alias("_row")
    return weeks.where(_year_week() >= since_year * 100 + since_week).agg(lowest).select(
        F.col("_row.year").alias("year_of_lowest"),
        F.col("_row.week").alias("week_of_lowest"),
        F.col("_row.lowest_total").alias("lowest_total"),
    )


def peak_after(weeks: DataFrame, lowest: DataFrame, total: str) -> DataFrame:
    """The week with the highest total from the trough on; the earliest of equals."""
    start = lowest.select(F.col("year_of_lowest") * 100 + F.col("week_of_lowest")).scalar()
    row = F.struct((-F.col(total)).alias("minus_total"), "year", "week")
    highest = F.min(F.when(F.col(total).isNotNull(), row)).alias("_row")
    return weeks.where(_year_week() >= start).agg(highest).select(
        F.col("_row.year").alias("year_of_peak"),
        F.col("_row.week").alias("week_of_peak"),
        (-F.col("_row.minus_total")).alias("peak_total"),
    )


def latest_week_report(
    weeks: DataFrame, lookup: DataFrame, as_of_year: int, since_year: int, short: str = "jam"
) -> DataFrame:
    """One row: the latest week of a year with its trough and peak.

    ``weeks`` is read three times; hand in a staged table. The parts are single
    rows, joined as scalar subqueries.
    """
    total = f"weekly_sum_{short}"
    low = trough(weeks, since_year, total)
    high = peak_after(weeks, low, total)
    columns = ["week", total, f"weekly_prior_{short}", f"change_from_prior_{short}"]
    latest = (
        weeks.where(F.col("year") == as_of_year)
        .agg(F.max_by(F.struct("year", *columns), "week").alias("_row"))
        .select("_row.*")
        .join(lookup, ["year", "week"], "left")
    )
    return latest.select(
        "week", "week_ending_date", *columns[1:],
        *[low.select(c).scalar().alias(c) for c in low.columns],
        *[high.select(c).scalar().alias(c) for c in high.columns],
    )


def weekly_totals_check(weekly: DataFrame, kinds=KINDS) -> DataFrame:
    """Totals per week by kind, over all kinds, and against the window baseline."""
    sums = weekly.groupBy("year", "week").agg(
        *[nulls.sum_or_zero(f"week_sum_{k}").alias(SHORT[k]) for k in kinds],
        *[nulls.sum_or_zero(f"window_mean_{k}").alias(f"_base_{k}") for k in kinds],
    )
    totals = sums.withColumns({
        "total_now": nulls.row_sum(*[SHORT[k] for k in kinds]),
        "total_base": nulls.row_sum(*[f"_base_{k}" for k in kinds]),
    })
    change = nulls.relative_change("total_now", "total_base")
    return totals.withColumn("pct_change", change).drop(*[f"_base_{k}" for k in kinds])


def _zero_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def _capped(change):
    return F.when(change < MAX_PERCENT_CHANGE, change)


def capped_change_day(daily: DataFrame, kinds=KINDS) -> DataFrame:
    """Daily change from the matched mean, whole percents, capped."""
    df = _zero_to_null(daily, [f"prior_mean_{k}" for k in kinds])
    return df.withColumns({
        f"pct_{SHORT[k]}": _capped(
            100 * nulls.rounded(nulls.relative_change(f"count_{k}", f"prior_mean_{k}"), 2)
        )
        for k in kinds
    })


def capped_change_week(weekly: DataFrame, kinds=KINDS) -> DataFrame:
    """Weekly change from the year before and from the previous week, capped."""
    bases = {"prior_year": "", "prev_week": "_prev"}
    df = _zero_to_null(weekly, [f"{b}_{k}" for b in bases for k in kinds])
    return df.withColumns({
        f"pct_{SHORT[k]}{suffix}": _capped(
            nulls.rounded(
                nulls.ratio(100 * (F.col(f"week_sum_{k}") - F.col(f"{b}_{k}")), f"{b}_{k}"), 2
            )
        )
        for b, suffix in bases.items()
        for k in kinds
    })


def latest_by_state(changes: DataFrame, state: str, period, shown: list[str]) -> DataFrame:
    """Rows of a state for the most recent period found in the whole table."""
    newest = changes.select(period.alias("_p")).agg(F.max("_p")).scalar()
    return changes.where((F.col("state") == state) & (period == newest)).select(*shown)


def metro_scorecard(day: DataFrame, week: DataFrame, state: str, csa: str) -> DataFrame:
    """Six numbers of a metro area: safety and congestion by period and comparison.

    The newest day and week are those of the whole table, so an area that has
    stopped reporting has no current numbers.
    """
    own = F.col("csa_title") == csa
    daily = latest_by_state(day, state, F.col("date"), ["csa_title", "pct_crash", "pct_jam"]).where(own)
    shown = ["csa_title", "pct_crash", "pct_jam", "pct_crash_prev", "pct_jam_prev"]
    weekly = latest_by_state(week, state, _year_week(), shown).where(own)
    long = (
        name_value_rows(daily, ["csa_title"], ["pct_crash", "pct_jam"])
        .withColumn("time_period", F.lit("Daily"))
        .unionByName(
            name_value_rows(weekly, ["csa_title"], shown[1:]).withColumn("time_period", F.lit("Weekly"))
        )
        .withColumns({
            "index": F.when(F.col("variable").contains("crash"), "safety").otherwise("congestion"),
            "comparison": F.when(F.col("variable").endswith("_prev"), "From Previous Week")
            .otherwise("From Prior Year"),
        })
    )
    paired = widen(long, ["time_period", "comparison"], "index", {"index": "value"},
                   ("safety", "congestion"))
    return paired.withColumnsRenamed(
        {"index_safety": "safety_index", "index_congestion": "congestion_index"}
    )


def state_weekly_counts(
    panel: DataFrame, prefix: str, kind: str, years, after_week: int, before_week: int
) -> DataFrame:
    """Weekly sums of one kind for places with a code prefix, by calendar year."""
    weeks = panel.where(
        F.col("fips").startswith(prefix)
        & (F.col("alert_type") == kind)
        & dates.in_years("date", years)
    ).groupBy(F.year("date").alias("year"), dates.epi_week("date").alias("week"))
    inside = (F.col("week") > after_week) & (F.col("week") < before_week)
    return weeks.agg(nulls.sum_or_zero("count").alias("total_count")).where(inside)


def top_periods(
    events: DataFrame, by: list[str], period: str, value: str, n: int = TOP_PERIODS
) -> DataFrame:
    """The ``n`` periods of each place with the highest totals; earlier of equals.

    The window runs over totals, one row per place and period.
    """
    totals = events.groupBy(*by, period).agg(
        nulls.strict_sum(value).alias("sum_count"), F.count(F.lit(1)).alias("samp")
    )
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last("sum_count"), period)
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def coverage_by_place(daily: DataFrame, place: str, value: str = "sum_count") -> DataFrame:
    """Share of days with at least one event, per place."""
    counted = daily.groupBy(place).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col(value) > 0).alias("obs_days")
    )
    return counted.withColumn("pct_obs", F.col("obs_days") / F.col("n_days"))


def coverage_stats(daily: DataFrame, place: str, value: str = "sum_count") -> DataFrame:
    """Spread of the coverage over places.

    Shares of a bounded number of days take few distinct values, so the exact
    median works on their frequencies.
    """
    shares = coverage_by_place(daily, place, value).groupBy("pct_obs").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return shares.agg(
        F.min("pct_obs").alias("min_pct"),
        F.percentile("pct_obs", F.lit(0.5), F.col("_n")).alias("med_pct"),
        nulls.ratio(F.sum(F.col("pct_obs") * F.col("_n")), F.sum("_n")).alias("mean_pct"),
        F.max("pct_obs").alias("max_pct"),
    )


def same_month_compare(panel: DataFrame, ranges: list[tuple[str, str]]) -> DataFrame:
    """Rows of several date ranges in one pass, aligned by day of month."""
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return panel.where(inside).withColumns(
        {"year": F.year("date"), "day_of_month": F.dayofmonth("date")}
    )


def filter_years_months(
    panel: DataFrame, years=None, months=None, states=None, places=None, kinds=None
) -> DataFrame:
    """Slices by year, month, state, place and kind; None keeps all."""
    wanted = {
        "state": states, "fips": places, "alert_type": kinds,
    }
    df = panel
    if years is not None:
        df = df.where(dates.in_years("date", years))
    if months is not None:
        df = df.where(dates.month_text("date").isin(list(months)))
    for column, values in wanted.items():
        if values is not None:
            df = df.where(F.col(column).isin(list(values)))
    return df.withColumns({"year": F.year("date"), "month": dates.month_text("date")})


def reference_counties(
    events: DataFrame, listed: DataFrame, key: str, order: str, check: bool = False
) -> DataFrame:
    """Events in the listed places with the list's columns and the year-month.

    With ``check`` the places of the list and of the events must be the same.
    """
    once = first_per_key(listed, [key], [order])
    kept = events.join(once, key)
    if check:
        assert_same_keys(kept, once, [key])
    return kept.withColumn("ym", dates.year_month("date"))


def active_days(daily: DataFrame, place: str, since: str, value: str = "sum_count") -> DataFrame:
    """Days after a cut-off with at least one event, per place."""
    return (
        daily.where(F.col("date") > F.lit(since).cast("date"))
        .groupBy(place)
        .agg(F.count_if(F.col(value) > 0).alias("active_days"))
    )


def combined_daily_total(wide: DataFrame, state: str, kinds=KINDS) -> DataFrame:
    """Sum of all kinds per row for a state; NULL when a kind is missing."""
    return wide.where(F.col("state") == state).withColumn(
        "combined", nulls.row_sum(*[f"count_{k}" for k in kinds])
    )
