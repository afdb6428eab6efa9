"""Places in space: sub-type counts, polygons, map frames, paths, metro areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.constants import KINDS
from panelkit.functions import nulls, text
from panelkit.operators.keys import keep_members
from panelkit.session import stage


def subtype_day_counts(
    df: DataFrame, state_code: str, county_code: str, date: str, sub_type: str, value: str
) -> DataFrame:
    """Rows and sum per (state, day, place, sub-type); the place code is padded."""
    fips = F.concat(text.padded(state_code, 2), text.padded(county_code, 3))
    return (
        df.withColumn("fips", fips)
        .groupBy(state_code, date, "fips", sub_type)
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            nulls.sum_or_zero(value).alias("sum_counts"),
        )
    )


def county_name_dim(names: DataFrame, vertices: DataFrame, label: str = "polyname") -> DataFrame:
    """Vertices with the place code found by the ``state,county`` name."""
    region, subregion = text.split_pair(label)
    named = names.select("fips", region.alias("region"), subregion.alias("subregion"))
    return vertices.join(named, ["region", "subregion"], "left")


def outlines(vertices: DataFrame) -> DataFrame:
    """One row per polygon with its vertices in order.

    A polygon is a bounded list, so counts join to it without a row per vertex.
    """
    points = F.array_sort(F.collect_list(F.struct("ord", "long", "lat"))).alias("outline")
    return vertices.groupBy("fips", "group").agg(points)


def map_frame(
    vertices: DataFrame, counts: DataFrame, state: tuple[str, object], date: str, sub_type: str
) -> DataFrame:
    """Outline vertices of a state with the counts of one day and sub-type, the
    frame's limits, and the largest count; no rows when nothing was reported."""
    column, code = state
    # Limits, the largest count and the rows all follow from one pass over the events.
    in_state = stage(counts.where(F.col(column) == code), "in-state")
    shapes = outlines(vertices)
    framed = keep_members(vertices, in_state.select("fips").distinct(), "fips")
    limits = framed.agg(
        F.struct(
            F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
            F.min("long").alias("min_long"), F.max("long").alias("max_long"),
        )
    ).scalar()
    largest = in_state.where(F.col("sub_type") == sub_type).agg(F.max("sum_counts")).scalar()
    chosen = in_state.where(
        (F.col("date") == F.lit(date).cast("date")) & (F.col("sub_type") == sub_type)
    )
    return (
        shapes.join(chosen, "fips")
        .select("fips", "group", "date", "sub_type", "sum_counts", F.inline("outline"))
        .withColumn("_limits", limits)
        .withColumn("largest_count", largest)
        .select("*", "_limits.*")
        .drop("_limits")
    )


def event_paths(
    points: DataFrame, qualifying: DataFrame, path: str, seq: str, x: Column, y: Column,
    run_length: int = 1_000_000,
) -> DataFrame:
    """One ``LINESTRING`` per path that occurs in ``qualifying``.

    A path is joined in two steps: runs of ``run_length`` sequence numbers in
    parallel, then the runs in order, so the points of one long path are sorted
    by many tasks.
    """
    kept = keep_members(points, qualifying.select(path), path)
    runs = (
        kept.withColumns({"_run": F.floor(F.col(seq) / run_length), "_xy": text.point_text(x, y)})
        .groupBy(path, "_run")
        .agg(
            F.expr(f"listagg(_xy, ',') WITHIN GROUP (ORDER BY {seq})").alias("_part"),
            F.count(F.lit(1)).alias("_n"),
        )
    )
    line = F.expr("listagg(_part, ',') WITHIN GROUP (ORDER BY _run)")
    return runs.groupBy(path).agg(
        F.sum("_n").alias("n_points"),
        F.concat(F.lit("LINESTRING("), line, F.lit(")")).alias("geometry"),
    )


def metro_filter(
    panel: DataFrame, delineation: DataFrame, key: str = "fips", *, metro_type: str | None = None,
    require_csa: bool = False, central_only: bool = False,
) -> DataFrame:
    """Places of the delineation, with its columns attached."""
    if metro_type is not None:
        delineation = delineation.where(F.col("metro_type") == metro_type)
    if require_csa:
        delineation = delineation.where(F.col("csa_title").isNotNull())
    if central_only:
        delineation = delineation.where(F.col("central_outlying") == "Central")
    return panel.join(delineation, key)


def _rollup(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[nulls.sum_or_zero(m).alias(m) for m in measures])


def metro_rollup_day(daily: DataFrame, kinds=KINDS) -> DataFrame:
    """Sums over the places of a metro area per day."""
    measures = [f"{m}_{k}" for m in ("count", "prior_mean") for k in kinds]
    return _rollup(daily, ["csa_title", "state", "date", "year", "month", "dow"], measures)


def metro_rollup_week(weekly: DataFrame, kinds=KINDS) -> DataFrame:
    """Sums over the places of a metro area per week."""
    measures = [f"{m}_{k}" for m in ("week_sum", "prior_year", "prev_week") for k in kinds]
    return _rollup(weekly, ["csa_title", "state", "year", "month_start", "week"], measures)
