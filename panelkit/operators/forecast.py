"""Forecasts for many monthly series at once.

A series is bounded by its number of months, which bounds every window here.
Models are pooled over all series, so the work grows with the data and not with
a loop over series on the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.constants import HORIZON, LAGS, SEASON
from panelkit.functions import dates
from panelkit.session import shared_path, stage

# Forest settings for forecasting.
FORECAST_FOREST = {"numTrees": 500, "featureSubsetStrategy": "onethird", "minInstancesPerNode": 5, "maxDepth": 15}


def _months_away(value, by: list[str], months: int):
    """The value of the same series so many months later (earlier, if negative); NULL in a gap."""
    month = F.year("period") * 12 + F.month("period")
    return F.max(value).over(W.partitionBy(*by).orderBy(month).rangeBetween(months, months))


def long_series(wide: DataFrame, by: list[str], year: str, months: list[str], until: str) -> DataFrame:
    """Year x month columns to dated rows; missing values dropped, end cut."""
    text = F.concat_ws(" ", F.col("month"), F.col(year).cast("string"))
    return (
        wide.unpivot([*by, year], months, "month", "value")
        .withColumn("period", dates.parse_month(text))
        .dropna(subset=["value"])
        .where(F.col("period") <= F.lit(until).cast("date"))
        .select(*by, "period", "value")
    )


def holdout_window(series: DataFrame, end: str) -> DataFrame:
    """Mark periods up to ``end`` as training."""
    return series.withColumn("is_train", F.col("period") <= F.lit(end).cast("date"))


def log_diff(series: DataFrame, by: list[str], lag: int = 1) -> DataFrame:
    """Difference of logs at a lag in months; rows without a value to compare are dropped."""
    log = F.ln("value")
    return series.withColumn("y", log - _months_away(log, by, -lag)).where(
        F.col("y").isNotNull()
    )


def lag_embed(series: DataFrame, by: list[str], k: int = LAGS, value: str = "y") -> DataFrame:
    """The value with those of the ``k`` months before as columns; incomplete rows dropped."""
    lags = {f"lag{i}": _months_away(F.col(value), by, -i) for i in range(1, k + 1)}
    return series.withColumns(lags).dropna(subset=list(lags))


def direct_forecast(
    series: DataFrame, by: list[str], end: str, *, lags: int = LAGS, horizon: int = HORIZON,
    forest: dict = FORECAST_FOREST, parallel_fits: int = 12, seed: int = 2019,
) -> DataFrame:
    """Forecast of ``y`` for each step after ``end``, a forest per step.

    The features are the last ``lags`` values up to a month; the target of step
    h is the value h months later. The last month of each series predicts.
    """
    train = series.where(F.col("period") <= F.lit(end).cast("date"))
    features = [f"x{i}" for i in range(lags)]
    framed = train.withColumns({
        **{f: _months_away(F.col("y"), by, -i) for i, f in enumerate(features)},
        **{f"target{h}": _months_away(F.col("y"), by, h) for h in range(1, horizon + 1)},
        "is_last": F.max("period").over(W.partitionBy(*by)) == F.col("period"),
    }).dropna(subset=features)
    table = VectorAssembler(inputCols=features, outputCol="features").transform(
        stage(framed, "embedded")
    )
    last = table.where("is_last")

    spark, path = series.sparkSession, shared_path(series.sparkSession, "steps")

    def step(h: int) -> T.StructType:
        model = RandomForestRegressor(labelCol=f"target{h}", predictionCol="y_hat", seed=seed, maxMemoryInMB=512, **forest)
        fitted = model.fit(table.dropna(subset=[f"target{h}"]))
        forecast = fitted.transform(last).select(*by, F.lit(h).alias("step"), "y_hat")
        forecast.write.parquet(f"{path}/part={h}")
        return forecast.schema

    with ThreadPoolExecutor(parallel_fits) as pool:
        schema = list(pool.map(step, range(1, horizon + 1)))[0]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def last_values(series: DataFrame, by: list[str], end: str) -> DataFrame:
    """The last training value of each series."""
    train = series.where(F.col("period") <= F.lit(end).cast("date"))
    return train.groupBy(*by).agg(
        F.max_by("value", "period").alias("last_value"), F.max("period").alias("last_period")
    )


def back_transform(forecast: DataFrame, last: DataFrame, by: list[str], y: str = "y_hat") -> DataFrame:
    """Last value times the exponential of the summed log differences."""
    so_far = W.partitionBy(*by).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return forecast.join(last, by).select(
        *by, "step",
        F.add_months("last_period", F.col("step")).alias("period"),
        (F.col("last_value") * F.exp(F.sum(y).over(so_far))).alias("forecast"),
    )


def forecast_frame(series: DataFrame, forecast: DataFrame, by: list[str]) -> DataFrame:
    """History with the forecast next to it, NULL in the training span."""
    return series.join(forecast.select(*by, "period", "forecast"), [*by, "period"], "left")


def seasonal_naive(
    series: DataFrame, by: list[str], end: str, season: int = SEASON, horizon: int = HORIZON
) -> DataFrame:
    """The same month of the last training season, repeated over the horizon."""
    end_date = F.lit(end).cast("date")
    last_season = series.where(
        (F.col("period") <= end_date) & (F.col("period") > F.add_months(end_date, -season))
    )
    rounds = -(-horizon // season)
    return (
        last_season.select(*by, "period", "value", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("_r"))
        .select(*by, F.add_months("period", F.col("_r") * season).alias("period"),
                F.col("value").alias("forecast"))
        .where(F.col("period") <= F.add_months(end_date, horizon))
    )


def forecast_accuracy(rows: DataFrame, by: list[str], actual: str = "value", forecast: str = "forecast") -> DataFrame:
    """Mean error, root mean squared, mean absolute, and percentage errors per series."""
    error = F.col(actual) - F.col(forecast)
    percent = 100 * error / F.nullif(F.col(actual), F.lit(0))
    return rows.dropna(subset=[actual, forecast]).groupBy(*by).agg(
        F.avg(error).alias("me"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(percent).alias("mpe"),
        F.avg(F.abs(percent)).alias("mape"),
    )
