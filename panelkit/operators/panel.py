"""Panel building: daily counts, complete grids, true zeros, weekly and daily
comparison tables.

A panel has one row per place, day and kind. Aggregates of raw events combine
inside the map tasks first, so a place that holds a third of the raw rows sends
at most one row per task, day and kind through the shuffle. After that, a place
has at most one row per calendar day and kind, which bounds every window below
that is partitioned by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.constants import KINDS
from panelkit.functions import dates, nulls
from panelkit.operators.keys import keep_members, key_union, once
from panelkit.operators.reshape import widen, widen_sums
from panelkit.session import rebalanced, stage


def daily_counts(
    events: DataFrame, place: Column, date: str, kind: str, value: str, name: str = "fips"
) -> DataFrame:
    """Hourly counts to (place, day, kind); a NULL count makes the sum NULL."""
    return (
        events.withColumn(name, place)
        .where(F.col(name).isNotNull())
        .groupBy(name, date, kind)
        .agg(nulls.strict_sum(value).alias(value))
    )


def known_places(dimension: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Rows of the dimension for the keys that occur in any source."""
    return keep_members(dimension, key_union(key, *sources), key)


def _spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by key over a number of tasks that adaptive execution leaves alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _place_days(counts: DataFrame, places: DataFrame, place: str, date: str, kind: str) -> DataFrame:
    """Every place x observed day, with the list of observed kinds.

    Days and kinds are bounded by the calendar and the code list. They are
    reduced to one row, used as a scalar subquery, and expanded per place, so
    no join without keys takes place. The few places are spread over a fixed
    number of tasks first; adaptive execution would otherwise put them, and the
    whole expansion, into one.
    """
    seen = counts.agg(
        F.struct(F.collect_set(date).alias("days"), F.collect_set(kind).alias("kinds"))
    ).scalar()
    return (
        _spread(places.select(place).where(F.col(place).isNotNull()), place)
        .distinct()
        .withColumn("_seen", seen)
        .select(place, F.explode("_seen.days").alias(date), F.col("_seen.kinds").alias("_kinds"))
    )


def complete_grid(
    counts: DataFrame, places: DataFrame, place: str = "fips", date: str = "date",
    kind: str = "alert_type",
) -> DataFrame:
    """Every place x observed day x observed kind, with the counts that exist."""
    days = _place_days(counts, places, place, date, kind)
    grid = days.select(place, date, F.explode("_kinds").alias(kind))
    return grid.join(counts, [place, date, kind], "left")


def complete_panel(
    counts: DataFrame, places: DataFrame, value: str = "count", place: str = "fips",
    date: str = "date", kind: str = "alert_type",
) -> DataFrame:
    """:func:`complete_grid` and :func:`fill_true_zeros` with one join fewer keys.

    The kinds of a place-day travel as one small map, so grid and counts meet
    once per place and day, and the zeros follow from the map without a second
    shuffle.
    """
    known = F.map_from_entries(F.collect_list(F.struct(kind, value))).alias("_known")
    by_day = counts.where(F.col(kind).isNotNull()).groupBy(place, date).agg(known)
    reported = F.coalesce(
        F.exists(F.map_values("_known"), lambda v: v.isNotNull()), F.lit(False)
    )
    found = F.try_element_at("_known", F.col(kind))
    return (
        _place_days(counts, places, place, date, kind)
        .join(by_day, [place, date], "left")
        .select(place, date, F.explode("_kinds").alias(kind), "_known", reported.alias("_reported"))
        .select(
            place, date, kind,
            F.when(F.col("_reported"), F.coalesce(found, F.lit(0))).otherwise(found).alias(value),
        )
    )


def fill_true_zeros(panel: DataFrame, value: str, within: list[str]) -> DataFrame:
    """0 where another kind reported for the same place and day, else NULL."""
    reported = F.count(value).over(W.partitionBy(*within)) > 0
    return panel.withColumn(
        value, F.when(reported, F.coalesce(F.col(value), F.lit(0))).otherwise(F.col(value))
    )


def attach_measure(panel: DataFrame, measure: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a measure that repeats over the kinds of a place and day.

    Rows of the panel stay as they are; a repeated key of the measure is an error.
    """
    return panel.join(once(measure, on), on, "left")


def attach_dimension(panel: DataFrame, dimension: DataFrame, key: str = "fips") -> DataFrame:
    """Names of the dimension in place of any the panel already has; a repeated key of the dimension is an error."""
    stale = [c for c in dimension.columns if c != key and c in panel.columns]
    return panel.drop(*stale).join(once(dimension, [key]), key, "left")


def fill_from_first_observed(
    panel: DataFrame, date: str, cols: list[str], observed: DataFrame | None = None
) -> DataFrame:
    """0 from the first day on which the first column is known anywhere; NULL before.

    ``observed`` may name a smaller table that has the same first day, which
    spares a second pass over the panel.
    """
    source = panel if observed is None else observed
    first = source.where(F.col(cols[0]).isNotNull()).agg(F.min(date)).scalar()
    filled = {
        c: F.when(F.col(date) >= first, F.coalesce(F.col(c), F.lit(0))).otherwise(F.col(c))
        for c in cols
    }
    return panel.withColumns(filled)


def exclude_kinds(panel: DataFrame, kinds, kind: str = "alert_type") -> DataFrame:
    return panel.where(nulls.excluded(kind, kinds))


def build_panel(
    daily: DataFrame, cases: DataFrame, dimension: DataFrame, exclude=("ROAD_CLOSED",)
) -> DataFrame:
    """Counts completed, zero-filled, with cases, names and calendar columns.

    ``daily`` is the result of :func:`daily_counts`. It is used three times
    here; hand in a staged table when it comes from a large scan. Cases and the
    known places, which several branches use, are written once.
    """
    cases = stage(cases, "cases")
    places = stage(known_places(dimension, "fips", daily, cases), "places")
    panel = complete_panel(daily, places)
    panel = attach_measure(panel, cases.select("fips", "date", "cases", "deaths"), ["fips", "date"])
    panel = attach_dimension(panel, places)
    in_span = keep_members(keep_members(cases, daily.select("date").distinct(), "date"), places, "fips")
    panel = fill_from_first_observed(panel, "date", ["cases", "deaths"], observed=in_span)
    panel = dates.calendar_parts(panel).drop("week_year", "iso_week", "epi_year", "epi_week")
    return exclude_kinds(panel, exclude)


def zero_fill_days(
    events: DataFrame, place: str, date: str, value: str, attributes: list[str]
) -> DataFrame:
    """Every place x observed day, 0 where nothing happened; attributes carried.

    The events are read once; days and places come from the staged daily sums.
    """
    daily = stage(
        events.groupBy(place, date).agg(
            F.sum(value).alias("sum_count"), F.count(F.lit(1)).alias("samp"),
            F.min(F.struct(*attributes)).alias("_attributes"),
        ),
        "daily",
    )
    seen = daily.agg(F.collect_set(date)).scalar()
    grid = (
        _spread(daily.select(place, date, "_attributes"), place)
        .groupBy(place).agg(F.min_by("_attributes", date).alias("_attributes"))
        .select(place, "_attributes.*", F.explode(seen).alias(date))
    )
    sums = daily.drop("_attributes")
    return grid.join(sums, [place, date], "left").fillna({"sum_count": 0, "samp": 0})


def weekly_panel(
    panel: DataFrame, place: list[str], kinds=KINDS, value: str = "count", date: str = "date",
    window: tuple[str, str] | None = None,
) -> DataFrame:
    """Weekly sums per place, wide by kind, with the same week of the year before
    and the previous week, and optionally the mean week of a baseline window.

    The comparisons are range frames over one shuffle by place: the key
    ``year*100+week`` less 100 is the same week one year back, the week's number
    counted in whole weeks less 1 is the week before. A missing week gives NULL.
    """
    weekly = widen_sums(
        panel.withColumns({
            "year": dates.epi_year(date), "week": dates.epi_week(date),
            "_saturday": dates.week_ending(date),
        }),
        [*place, "year", "week", "_saturday"], "alert_type", value, "week_sum", kinds,
    ).withColumns({
        "_year_week": F.col("year") * 100 + F.col("week"),
        "_week_number": F.floor(F.unix_date("_saturday") / 7).cast("int"),
        "month_start": F.month(F.date_sub("_saturday", 6)),
    })
    by_place = W.partitionBy(*place)
    year_back = by_place.orderBy("_year_week").rangeBetween(-100, -100)
    week_back = by_place.orderBy("_week_number").rangeBetween(-1, -1)
    added = {f"prior_year_{k}": F.max(f"week_sum_{k}").over(year_back) for k in kinds}
    added |= {f"prev_week_{k}": F.max(f"week_sum_{k}").over(week_back) for k in kinds}
    if window:
        start, end = (F.lit(d).cast("date") for d in window)
        inside = (F.date_sub("_saturday", 6) >= start) & (F.col("_saturday") <= end)
        added |= {
            f"window_mean_{k}": F.avg(F.when(inside, F.col(f"week_sum_{k}"))).over(by_place)
            for k in kinds
        }
    return weekly.withColumns(added).drop("_saturday", "_year_week", "_week_number")


def daily_match_panel(
    panel: DataFrame, place: list[str], kinds=KINDS, value: str = "count", date: str = "date"
) -> DataFrame:
    """Daily counts wide by kind, with the mean of the same month and weekday of
    the year before."""
    daily = widen(panel, [*place, date], "alert_type", {"count": value}, kinds).withColumns({
        "year": F.year(date), "month": dates.month_text(date), "dow": dates.day_of_week(date),
    })
    year_back = W.partitionBy(*place, "month", "dow").orderBy("year").rangeBetween(-1, -1)
    return daily.withColumns(
        {f"prior_mean_{k}": F.avg(f"count_{k}").over(year_back) for k in kinds}
    )


def last_complete_day(panel: DataFrame, date: str = "date", value: str = "count") -> DataFrame:
    """The latest day with any count, with its total and its missing cells."""
    per_day = panel.groupBy(date).agg(
        nulls.sum_or_zero(value).alias("total_count"),
        F.count(value).alias("known_cells"),
        nulls.null_count(value).alias("null_cells"),
    )
    columns = [date, "total_count", "known_cells", "null_cells"]
    latest = F.max_by(F.struct(*columns), F.col(date)).alias("latest")
    return per_day.where("known_cells > 0").agg(latest).select("latest.*")


WEEK, MONTH = ["year", "week"], ["year", "month"]


def _rewrite(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that ``rows`` has, and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_stored(like: DataFrame, path: str) -> DataFrame:
    """A stored panel with the columns and types of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(path).select(*like.columns)


def write_weekly(weekly: DataFrame, path: str) -> None:
    _rewrite(rebalanced(weekly, WEEK), path, WEEK)


def write_daily_match(daily: DataFrame, path: str) -> None:
    _rewrite(rebalanced(daily, MONTH), path, MONTH)


def _weeks_of(days: DataFrame, date: str, *shifts: tuple[int, int]) -> DataFrame:
    """Keys of the weeks so many years after and then so many days after each of some days."""
    spots = [F.struct((dates.epi_year(F.date_add(date, d)) + y).alias("year"), dates.epi_week(F.date_add(date, d)).alias("week")) for y, d in shifts]
    return days.select(F.explode(F.array(*spots)).alias("k")).select("k.*").distinct()


def refresh_weekly(
    panel: DataFrame, late: DataFrame, path: str, place: list[str], kinds=KINDS, value: str = "count", date: str = "date",
    window: tuple[str, str] | None = None,
) -> None:
    """Bring a stored :func:`weekly_panel` up to date after days that came late (``late``, a table of dates).

    Written anew are the weeks of those days, and the weeks that look back at them:
    the next one, and the same one a year later. They are computed from the days of
    these weeks and of those that they look back at. Late days within the window
    change the mean of every week, so then all weeks are written anew.
    """
    days = late.select(date).where(F.col(date).isNotNull()).distinct()
    if window:
        start, end = (F.lit(d).cast("date") for d in window)
        inside = F.date_sub(dates.week_ending(date), 6).between(start, end) & (dates.week_ending(date) <= end)
        if not days.where(inside).isEmpty():
            write_weekly(weekly_panel(panel, place, kinds, value, date, window), path)
            return
    keyed = panel.withColumns({"_year": dates.epi_year(date), "_week": dates.epi_week(date)})
    changed = stage(_weeks_of(days, date, (0, 0), (0, 7), (1, 0)), "weeks")
    # A changed week needs itself, the week before, and the same week a year before.
    seen = keyed.select(date, F.col("_year").alias("year"), F.col("_week").alias("week")).distinct()
    here = seen.join(changed, WEEK, "left_semi")
    needed = _weeks_of(here, date, (0, 0), (0, -7), (-1, 0))
    if window:
        needed = needed.unionByName(_weeks_of(seen.where(F.col(date).between(start, end)), date, (0, 0))).distinct()
    rows = keyed.join(needed.withColumnsRenamed({"year": "_year", "week": "_week"}), ["_year", "_week"], "left_semi").select(*panel.columns)
    weekly = weekly_panel(rows, place, kinds, value, date, window)
    write_weekly(weekly.join(changed, WEEK, "left_semi"), path)


def refresh_daily_match(
    panel: DataFrame, late: DataFrame, path: str, place: list[str], kinds=KINDS, value: str = "count", date: str = "date"
) -> None:
    """Bring a stored :func:`daily_match_panel` up to date: the months of late days, and the same months a year later."""
    def months(days: DataFrame, *years: int) -> DataFrame:
        spots = [F.struct((F.year(date) + y).alias("year"), dates.month_text(date).alias("month")) for y in years]
        return days.select(F.explode(F.array(*spots)).alias("k")).select("k.*").distinct()

    changed = stage(months(late.where(F.col(date).isNotNull()), 0, 1), "months")
    keyed = panel.withColumns({"_year": F.year(date), "_month": dates.month_text(date)})
    before = changed.select((F.col("year") - 1).alias("year"), "month")
    needed = changed.unionByName(before).distinct().withColumnsRenamed({"year": "_year", "month": "_month"})
    rows = keyed.join(needed, ["_year", "_month"], "left_semi").select(*panel.columns)
    daily = daily_match_panel(rows, place, kinds, value, date)
    write_daily_match(daily.join(changed, MONTH, "left_semi"), path)
