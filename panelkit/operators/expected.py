"""Expected counts: one distributed forest per group, or a window mean.

The driver only holds the list of groups (states x kinds) with their number of
places, and the fitted models. Places are numbered in a table that joins the rows.
Each fit is a distributed job over that group's partition of one staged table; a
few fits run at the same time so that small groups do not leave the cluster idle.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.constants import FOREST, TEST_SHARE
from panelkit.functions import dates, nulls
from panelkit.operators import dictionary, samples
from panelkit.session import shared_path, stage

GROUP = ("state", "alert_type")
PLACE = "fips"
#: Categories with all their values; those of places are found in the data.
FIXED = {
    "month": [f"{m:02d}" for m in range(1, 13)],
    "dow": [str(d) for d in range(7)],
    "day_week": "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split(),
}
PREDICTORS = [*FIXED, PLACE, "weekend"]
#: Most values of a category that a forest can take; statistics of a split grow with them.
MAX_PLACES = 10_000


def model_features(panel: DataFrame) -> DataFrame:
    """The predictors: month, day of week, weekday name, weekend and place.

    Place stays one column; it is indexed as a category when a group is fitted,
    so no column per place is needed. The year is left out, because the target
    year never occurs in training.
    """
    return panel.withColumns({
        "month": dates.month_text("date"),
        "dow": dates.day_of_week("date").cast("string"),
        "day_week": dates.weekday_name("date"),
        "weekend": dates.is_weekend("date").cast("double"),
    })


def in_test(keys: list[str], share: float = TEST_SHARE) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(*keys), F.lit(1000)) < int(share * 1000)


def split_train_test(
    df: DataFrame, complete: list[str], test: Column, thin: Column | None = None
) -> DataFrame:
    """Complete cases with an ``is_test`` flag, optionally thinned first; :func:`samples.exact_split` gives exact sizes."""
    kept = df.dropna(subset=complete)
    return (kept if thin is None else kept.where(thin)).withColumn("is_test", test)


def forest_settings(forest: dict, n_features: int = len(PREDICTORS), classes: bool = False) -> dict:
    """Settings with the usual number of features to try at a split, if they name none:
    a third of them for numbers, the root for classes, rounded down, one at least."""
    usual = math.isqrt(n_features) if classes else max(n_features // 3, 1)
    return {"featureSubsetStrategy": str(usual), **forest}


def encoded(rows: DataFrame, places: DataFrame, n_places: int) -> DataFrame:
    """Rows of one group with each category as a number; what training hasn't seen shares the number after the last.

    ``places`` holds the group's places with their numbers. Their count is part of
    the column's metadata, from which the forest knows that it is a category.
    """
    def nominal(name: str, number: Column, n: int) -> Column:
        known = F.coalesce(number, F.lit(n)).cast("double")
        return known.alias(name, metadata={"ml_attr": {"type": "nominal", "name": name, "num_vals": n + 1}})

    joined = dictionary.encode(rows, places, [], PLACE, "_place")
    fixed = [nominal(f"{c}_index", dictionary.position(c, v), len(v)) for c, v in FIXED.items()]
    return joined.select(*rows.columns, *fixed, nominal(f"{PLACE}_index", F.col("_place"), n_places))


def fit_group(train: DataFrame, n_places: int, response: str, forest: dict, seed: int, classes: bool = False) -> PipelineModel:
    """One forest over the encoded training rows of a group."""
    bins = max(32, n_places + 1)
    if bins > MAX_PLACES:
        raise ValueError(f"{n_places} places in one group; a forest takes {MAX_PLACES - 1} at most")
    kind = RandomForestClassifier if classes else RandomForestRegressor
    assemble = VectorAssembler(inputCols=[*[f"{c}_index" for c in (*FIXED, PLACE)], "weekend"], outputCol="features")
    model = kind(
        labelCol=response, predictionCol="pred_count", maxBins=bins, seed=seed, maxMemoryInMB=512, cacheNodeIds=True, **forest_settings(forest, classes=classes)
    )
    return Pipeline(stages=[assemble, model]).fit(train)


def group_rows(df: DataFrame, group, values: tuple) -> DataFrame:
    return reduce(lambda d, gv: d.where(F.col(gv[0]).eqNullSafe(gv[1])), zip(group, values), df)


def group_places(places: DataFrame, group, values: tuple) -> DataFrame:
    return group_rows(places, group, values).select(PLACE, "id")


@dataclass
class ExpectedFit:
    """Models by group, the rows they were made from, and what they predict."""

    models: dict[tuple, PipelineModel]
    seconds: dict[tuple, float]
    group: tuple[str, ...]
    scored: DataFrame
    complete: DataFrame
    #: Places with their numbers per group, and how many each group has.
    places: DataFrame
    n_places: dict[tuple, int]

    @property
    def predictions(self) -> DataFrame:
        """Rows of the target year, whether or not their count is known."""
        return self.scored.where("is_target")

    @property
    def holdout(self) -> DataFrame:
        """Rows that were kept out of the fits."""
        return self.scored.where("not is_target")

    @property
    def training_sizes(self) -> DataFrame:
        return self.complete.groupBy(*self.group).agg(
            F.count_if(~F.col("is_test")).alias("n_fit"), F.count_if(F.col("is_test")).alias("n_test")
        )


def score_groups(
    rows: DataFrame, group, models: Callable[[tuple], PipelineModel], places: DataFrame, n_places: dict[tuple, int], parallel: int = 16,
    then: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """``rows`` (staged by group) with what each group's model predicts, as one table.

    The driver goes through the groups, a few at a time; each is a job of its own
    that writes its part. Rows of a group without a model are left out.
    """
    spark = rows.sparkSession
    path = shared_path(spark, "predictions")

    def score(values: tuple) -> T.StructType:
        own = encoded(group_rows(rows, group, values), group_places(places, group, values), n_places[values])
        scored = then(models(values).transform(own)).drop("features", *[f"{c}_index" for c in (*FIXED, PLACE)])
        scored.write.parquet(f"{path}/model={uuid.uuid4().hex}")
        return scored.schema

    with ThreadPoolExecutor(parallel) as pool:
        schemas = list(pool.map(score, n_places))
    if not schemas:
        return spark.createDataFrame([], T.StructType([*rows.schema.fields, T.StructField("pred_count", T.DoubleType())]))
    return spark.read.schema(schemas[0]).parquet(path).select(*schemas[0].names)


def fit_expected(
    panel: DataFrame, target_year: int, *, group=GROUP, response: str = "count", forest: dict | None = None,
    test_share: float = TEST_SHARE, test: Column | None = None, test_rows: DataFrame | None = None,
    pred_rows: DataFrame | None = None, thin: float | None = None, classes: bool = False,
    parallel_fits: int = 16, seed: int = 2019,
) -> ExpectedFit:
    """Fit the years before the target per group, to predict the target year.

    Held out are ``test_rows``, a table of their own, or else the rows that ``test``
    names, or else an exact share of each group. ``thin`` keeps an exact share of
    each group's earlier rows (and of ``test_rows``). ``pred_rows`` stand for the
    rows of the target year. With ``classes`` the response is a class from 0 on.
    """
    forest = FOREST if forest is None else forest
    if test_rows is not None and test is not None:
        raise ValueError("name either test_rows or test, not both")
    last = F.lit(f"{target_year}-12-31").cast("date")
    target = F.year("date") == target_year
    columns = panel.columns

    def flagged(rows: DataFrame, is_target: Column, is_test: Column) -> DataFrame:
        return rows.select(*columns, is_target.alias("is_target"), is_test.alias("is_test"))

    no = F.lit(False)
    known = panel.where(F.col("date") <= last)
    tables = [flagged(known, target, no if test is None else test)]
    if pred_rows is not None:
        tables = [flagged(known.where(~target), no, no if test is None else test), flagged(pred_rows, F.lit(True), no)]
    if test_rows is not None:
        tables.append(flagged(test_rows, no, F.lit(True)))
    table = stage(model_features(reduce(DataFrame.unionByName, tables)), "features", partition_by=group)
    complete = table.where(~F.col("is_target")).dropna(subset=[*PREDICTORS, response])
    if thin is not None:
        kept = samples.choose(complete, [*group, "is_test"], samples.share_of(thin), seed=seed + 1).where("chosen").drop("chosen")
        complete = stage(kept, "thinned", partition_by=group)
    if test is None and test_rows is None:
        split = samples.exact_split(complete.drop("is_test"), list(group), test_share, seed=seed)
        complete = stage(split.select(*table.columns), "split", partition_by=group)
    train = complete.where(~F.col("is_test"))
    places = stage(dictionary.dense_ids(train, list(group), PLACE), "places", partition_by=group)
    # A row per group: its name and how many places it has.
    n_places = {tuple(r[:len(group)]): r.n_values for r in dictionary.sizes(places, list(group)).collect()}
    seconds: dict[tuple, float] = {}
    models: dict[tuple, PipelineModel] = {}

    def fit(values: tuple) -> PipelineModel:
        start = time.monotonic()
        own = encoded(group_rows(train, group, values), group_places(places, group, values), n_places[values])
        models[values] = fit_group(own, n_places[values], response, forest, seed, classes)
        seconds[values] = time.monotonic() - start
        return models[values]

    applied = table.where("is_target").unionByName(complete.where("is_test"))
    scored = score_groups(applied, group, fit, places, n_places, parallel_fits)
    return ExpectedFit(models, seconds, tuple(group), scored, complete, places, n_places)


def fit_metrics(
    rows: DataFrame, group=GROUP, observed: str = "count", predicted: str = "pred_count"
) -> DataFrame:
    """Rows and mean squared error per model, over rows where both are known."""
    error = F.col(observed) - F.col(predicted)
    model = F.concat_ws("_", *group)
    return rows.dropna(subset=[observed, predicted]).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(error * error).alias("mse")
    ).withColumn("model", model)


def model_metrics(fit: ExpectedFit, group=GROUP, response: str = "count") -> DataFrame:
    """Training and test rows, error and fitting time per model."""
    spark = fit.holdout.sparkSession
    times = spark.createDataFrame(
        [(*g, s) for g, s in fit.seconds.items()],
        ", ".join([*[f"{g} string" for g in group], "runtime double"]),
    )
    errors = fit_metrics(fit.holdout, group, response).drop("n_test")
    return fit.training_sizes.join(errors, list(group), "left").join(times, list(group), "left")


def flag_models(metrics: DataFrame, p_high: float = 0.8, p_low: float = 0.1) -> DataFrame:
    """Models with an error above the high or below the low percentile.

    The metrics table has a row per model, so its exact percentiles are cheap.
    """
    limits = metrics.agg(F.struct(
        F.percentile("mse", F.lit(p_high)).alias("high"), F.percentile("mse", F.lit(p_low)).alias("low")
    )).scalar()
    flag = F.when(F.col("mse") > F.col("_limits.high"), "high").when(
        F.col("mse") < F.col("_limits.low"), "low"
    )
    flagged = metrics.withColumn("_limits", limits).withColumn("flag", flag).drop("_limits")
    return flagged.where(F.col("flag").isNotNull())


def compile_predictions(predictions: DataFrame) -> DataFrame:
    """All groups in one tidy table."""
    df = dates.calendar_parts(predictions)
    carried = [c for c in ("cases", "deaths") if c in df.columns]
    return df.select(
        "date", "state", "county", "alert_type", "count", "pred_count", *carried, "fips",
        "year", "month", "dow", "day_week", "weekend", "week_year",
    )


def baseline_mean_expected(panel: DataFrame, target_year: int, start: str, end: str) -> DataFrame:
    """The mean of the window's days with the same weekday as the expectation.

    One window over the target year by place, kind and weekday, so the panel is
    read once; it holds at most 53 rows.
    """
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    same_day = W.partitionBy("fips", "alert_type", "_dow")
    mean = F.avg(F.when(inside, F.col("count"))).over(same_day)
    return (
        panel.where(dates.in_years("date", [target_year]))
        .withColumn("_dow", F.dayofweek("date"))
        .withColumn("pred_count", nulls.rounded(mean, 1))
        .drop("_dow")
    )
