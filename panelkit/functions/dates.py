"""Calendar expressions: day of week, and three ways to number weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_week(d) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(_col(d)) - 1


def weekday_name(d) -> Column:
    return F.date_format(_col(d), "EEEE")


def is_weekend(d) -> Column:
    return F.dayofweek(_col(d)).isin(1, 7)


def simple_week(d) -> Column:
    """Blocks of seven days counted from January 1."""
    return (F.floor((F.dayofyear(_col(d)) - 1) / 7) + 1).cast("int")


def iso_week(d) -> Column:
    return F.weekofyear(_col(d))


def midweek(d) -> Column:
    """Wednesday of the Sunday-to-Saturday week; its year owns the week."""
    return F.date_add(_col(d), F.lit(3) - day_of_week(d))


def epi_week(d) -> Column:
    return simple_week(midweek(d))


def epi_year(d) -> Column:
    return F.year(midweek(d))


def week_ending(d) -> Column:
    """Saturday of the Sunday-to-Saturday week."""
    return F.date_add(_col(d), F.lit(6) - day_of_week(d))


def month_text(d) -> Column:
    return F.date_format(_col(d), "MM")


def year_month(d) -> Column:
    return F.date_format(_col(d), "yyyy-MM")


def month_start(d) -> Column:
    return F.trunc(_col(d), "month")


def days_in_month(d) -> Column:
    return F.dayofmonth(F.last_day(_col(d)))


def date_from_year_day(year, day) -> Column:
    """Date of the n-th day of a year."""
    return F.date_add(F.make_date(_col(year), F.lit(1), F.lit(1)), _col(day) - 1)


def parse_month(text) -> Column:
    """``Mon yyyy`` to the first day of that month."""
    return F.to_date(_col(text), "MMM yyyy")


def in_years(d, years) -> Column:
    """Whether a date falls in one of the years.

    The outer bounds are a plain date range, which reaches the scan; a test on
    ``year(date)`` alone would not.
    """
    d, years = _col(d), sorted(years)
    first, last = (F.lit(day).cast("date") for day in (f"{years[0]}-01-01", f"{years[-1]}-12-31"))
    inside = d.between(first, last)
    gaps = len(set(years)) <= years[-1] - years[0]
    return inside & F.year(d).isin(years) if gaps else inside


def calendar_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """Add year, month, day-of-week and week columns for a date."""
    return df.withColumns(
        {
            "year": F.year(date),
            "month": month_text(date),
            "dow": day_of_week(date),
            "day_week": weekday_name(date),
            "weekend": is_weekend(date),
            "week_year": simple_week(date),
            "iso_week": iso_week(date),
            "epi_year": epi_year(date),
            "epi_week": epi_week(date),
        }
    )


def days_spanned(df: DataFrame, date: str = "date") -> DataFrame:
    """One row per calendar day from the first to the last date in ``df``.

    The span is reduced to one row before it is expanded, so the expansion is
    bounded by the calendar whatever the size of ``df``.
    """
    span = df.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias(date)
    )
