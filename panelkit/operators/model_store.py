"""A store of fitted models by group, for use on data that come later.

Models and the numbers of their places are written below folders of their own. The
manifest, one ledger entry per group, is committed after all of them; a version that
is not in it does not exist for readers.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators import expected
from panelkit.session import stage
from panelkit.sources import ledger

FIELDS = "version long, path string, places string, n_places long, n_fit long, n_test long, error double, seconds double"


def _schema(group) -> str:
    return ", ".join([*[f"{g} string" for g in group], FIELDS])


def publish(fit: expected.ExpectedFit, base: str, response: str = "count", parallel: int = 16) -> int:
    """Save all models of a fit as the next version, which is returned; readers see it once all of it is there."""
    spark = fit.scored.sparkSession
    folder = write_parts(fit, base, parallel)
    version = max(versions(spark, base, fit.group), default=0) + 1
    metrics = expected.model_metrics(fit, fit.group, response)
    paths = spark.createDataFrame(
        [(*v, f"{folder}/models/{i}", fit.n_places[v]) for i, v in enumerate(fit.models)],
        ", ".join([*[f"{g} string" for g in fit.group], "path string, n_places long"]))
    rows = paths.join(metrics, list(fit.group), "left").select(
        *fit.group, F.lit(version).cast("long").alias("version"), "path", F.lit(f"{folder}/places").alias("places"), "n_places",
        "n_fit", "n_test", F.col("mse").alias("error"), F.col("runtime").alias("seconds"))
    ledger.commit(rows, base)
    return version


def write_parts(fit: expected.ExpectedFit, base: str, parallel: int = 16) -> str:
    """Models and places in a new folder that the manifest does not name yet."""
    folder = ledger.fresh_path(base, "versions")
    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(lambda i_model: i_model[1].write().save(f"{folder}/models/{i_model[0]}"), enumerate(fit.models.values())))
    fit.places.write.partitionBy(*fit.group).parquet(f"{folder}/places")
    return folder


def manifest(spark: SparkSession, base: str, group=expected.GROUP) -> DataFrame:
    """All published models: group, version, paths, sizes, error and fitting time."""
    return ledger.entries(spark, base, _schema(group))


def versions(spark: SparkSession, base: str, group=expected.GROUP) -> list[int]:
    return sorted(r.version for r in manifest(spark, base, group).select("version").distinct().collect())


def best_models(spark: SparkSession, base: str, group=expected.GROUP, version: int | None = None) -> DataFrame:
    """One model per group: of a version, or else of the newest that has the group."""
    found = manifest(spark, base, group)
    if version is not None:
        return found.where(F.col("version") == version)
    last = found.groupBy(*group).agg(F.max("version").alias("version"))
    return found.join(last, [*group, "version"], "left_semi")


def score(
    rows: DataFrame, base: str, group=expected.GROUP, version: int | None = None, parallel: int = 16,
) -> DataFrame:
    """Rows (with date and place) with ``pred_count`` by the stored model of their group; NULL where there is none.

    The driver reads the manifest, a row per group. Each group is scored by a job of
    its own over its part of one staged table.
    """
    spark = rows.sparkSession
    chosen = {tuple(r[g] for g in group): r for r in best_models(spark, base, group, version).collect()}
    if version is not None and not chosen:
        raise ValueError(f"version {version} is not published in {base}")
    columns = rows.columns
    featured = stage(expected.model_features(rows), "to-score", partition_by=group)
    # Groups of one version share a table of places.
    kinds = dict(rows.dtypes)
    fields = ", ".join([f"{expected.PLACE} {kinds[expected.PLACE]}, id long", *[f"{g} {kinds[g]}" for g in group]])
    tables = {path: spark.read.schema(fields).parquet(path) for path in {r.places for r in chosen.values()}}
    load = lru_cache(None)(lambda values: PipelineModel.load(chosen[values].path))
    parts = []
    for path, places in tables.items():
        own = {v: int(r.n_places) for v, r in chosen.items() if r.places == path}
        parts.append(expected.score_groups(featured, group, load, places, own, parallel).select(*columns, "pred_count"))
    known = spark.createDataFrame([(*v,) for v in chosen], ", ".join(f"{g} string" for g in group))
    rest = featured.join(known, list(group), "left_anti").select(*columns, F.lit(None).cast("double").alias("pred_count"))
    out = rest
    for part in parts:
        out = out.unionByName(part)
    return out
