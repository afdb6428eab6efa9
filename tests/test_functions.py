from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelkit.functions import dates, nulls, text


def epi(day: date) -> tuple[int, int]:
    """Week by hand: the Sunday-to-Saturday week belongs to its Wednesday's year."""
    wednesday = day - timedelta(days=(day.weekday() + 1) % 7) + timedelta(days=3)
    return wednesday.year, (wednesday.timetuple().tm_yday - 1) // 7 + 1


# Week numbers around year boundaries.
GOLDEN = {
    date(2014, 12, 28): (2014, 53), date(2015, 1, 3): (2014, 53), date(2015, 1, 4): (2015, 1),
    date(2020, 12, 26): (2020, 52), date(2020, 12, 27): (2020, 53), date(2021, 1, 2): (2020, 53),
    date(2021, 1, 3): (2021, 1), date(2026, 1, 1): (2025, 53), date(2026, 1, 4): (2026, 1),
}


def test_epi_week_golden(spark):
    df = spark.createDataFrame([(d,) for d in GOLDEN], "d date").select(
        "d", dates.epi_year("d"), dates.epi_week("d")
    )
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == GOLDEN


def test_week_numbers_for_every_day_of_thirteen_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2014-01-01', DATE'2026-12-31')) AS d")
    df = days.select("d", dates.epi_year("d"), dates.epi_week("d"), dates.iso_week("d"),
                     dates.simple_week("d"), dates.day_of_week("d"), dates.week_ending("d"))
    for d, year, week, iso, simple, dow, ending in df.collect():
        assert (year, week) == epi(d)
        assert iso == d.isocalendar()[1]
        assert simple == (d.timetuple().tm_yday - 1) // 7 + 1
        assert dow == (d.weekday() + 1) % 7
        assert ending == d + timedelta(days=6 - dow)


def test_year_day_and_month_length(spark):
    df = spark.createDataFrame([(2020, 60), (2021, 60), (2021, 365)], "y int, n int")
    built = df.select(dates.date_from_year_day("y", "n").alias("d"))
    assert [r.d for r in built.collect()] == [date(2020, 2, 29), date(2021, 3, 1), date(2021, 12, 31)]
    assert [r[0] for r in built.select(dates.days_in_month("d")).collect()] == [29, 31, 31]


def test_days_spanned_is_complete(spark):
    df = spark.createDataFrame([(date(2020, 2, 27),), (date(2020, 3, 2),), (date(2020, 2, 27),)], "date date")
    assert [r.date.day for r in dates.days_spanned(df).orderBy("date").collect()] == [27, 28, 29, 1, 2]
    assert dates.days_spanned(df.limit(0)).collect() == []


def test_years_with_gaps(spark):
    df = spark.createDataFrame([(date(y, 5, 1),) for y in range(1995, 2002)], "date date")
    kept = df.where(dates.in_years("date", [1996, 1999])).select(F.year("date"))
    assert rows(kept) == [(1996,), (1999,)]


def test_strict_and_present_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", None)], "g string, x long")
    out = df.groupBy("g").agg(nulls.strict_sum("x"), nulls.sum_or_zero("x"), nulls.null_count("x"))
    assert rows(out) == [("a", None, 1, 1), ("b", 5, 5, 0), ("c", None, 0, 1)]


def test_ratio_of_zero_base(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(nulls.relative_change("a", "b")).collect()] == [None, None, 0.5, None]


@pytest.mark.parametrize("cells, expected", [
    ([(1.0, 1.0), (4.0, 2.0)], 3.0),
    ([(1.0, 1.0), (None, 0.0)], 1.0),
    ([(1.0, 1.0), (None, 2.0)], None),
    ([(1.0, 1.0), (4.0, None)], None),
    ([(1.0, 0.0), (4.0, 0.0)], None),
])
def test_weighted_mean(spark, cells, expected):
    df = spark.createDataFrame(cells, "x double, w double")
    assert df.agg(nulls.weighted_mean("x", "w")).first()[0] == expected


def test_rounding_is_on_the_decimal_value(spark):
    df = spark.createDataFrame([(1.005,), (-1.005,), (0.15,), (None,)], "x double")
    assert [r[0] for r in df.select(nulls.rounded("x", 2)).collect()] == [1.01, -1.01, 0.15, None]


def test_excluded_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert rows(df.where(nulls.excluded("x", ["a"]))) == [(None,), ("b",)]


def test_finite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(nulls.finite("x")).collect()] == [None, None, None, 1.5, None]


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([(7,), (123456,), (None,)], "n int")
    assert [r[0] for r in df.select(text.padded("n", 5)).collect()] == ["00007", "123456", None]


def test_split_pair(spark):
    df = spark.createDataFrame([("iowa,polk",), ("iowa",), ("a,b,c",)], "x string")
    assert [tuple(r) for r in df.select(*text.split_pair("x")).collect()] == [
        ("iowa", "polk"), (None, None), (None, None)]


def test_legal_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`FIPS State` int, `2020` int, `a/b` int")
    assert text.legal_names(df).columns == ["FIPS_State", "X2020", "a_b"]
