"""Key handling: membership, first row per key, comparison of key sets, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_union(key: str, *frames: DataFrame) -> DataFrame:
    """Distinct non-NULL keys found in any of the frames."""
    keys = reduce(DataFrame.unionByName, [f.select(key) for f in frames])
    return keys.where(F.col(key).isNotNull()).distinct()


def keep_members(df: DataFrame, members: DataFrame, keys) -> DataFrame:
    return df.join(members, keys, "left_semi")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate rather than a window: copies of a hot key are already reduced
    to one row per task before the shuffle. Equal orders fall back on the values.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("picked")
    return df.groupBy(*keys).agg(picked).select(*keys, "picked.*").select(*df.columns)


def natural_keys(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on all shared columns; NULL keys match each other."""
    return null_safe_join(left, right, natural_keys(left, right), how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; left columns come first.

    Where the right side may have rows of its own (right and full outer joins),
    the keys are taken from the side that has the row.
    """
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    )
    joined = left.join(renamed, match, how)
    if how in ("right", "full", "outer", "full_outer", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(left[k], renamed[f"_{k}"]) for k in keys})
    return joined.drop(*[f"_{k}" for k in keys])


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, unless a key is repeated: then the query fails.

    The check is part of the plan. A left join to the result cannot repeat left rows.
    """
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_row"))
    told = F.concat(F.lit(f"repeated key of {keys}: "), F.to_json(F.struct(*keys)))
    row = F.when(F.col("_n") > 1, F.raise_error(told)).otherwise(F.col("_row"))
    return counted.select(*keys, row.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side; empty when the key sets are equal."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    both = null_safe_join(a, b, keys, "full_outer")
    side = F.when(F.col("in_right").isNull(), "left").when(F.col("in_left").isNull(), "right")
    return both.select(*keys, side.alias("only_in")).where(F.col("only_in").isNotNull())


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    different = key_difference(left, right, keys).limit(1).collect()
    if different:
        raise ValueError(f"key sets differ, e.g. {different[0].asDict()}")


def spot_check(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys whose values differ between two tables, or that one table lacks."""
    x = a.select(*keys, F.struct(*cols).alias("x"))
    y = b.select(*keys, F.struct(*cols).alias("y"))
    both = null_safe_join(x, y, keys, "full_outer")
    status = (
        F.when(F.col("y").isNull(), "only_left")
        .when(F.col("x").isNull(), "only_right")
        .when(~F.col("x").eqNullSafe(F.col("y")), "differs")
        .otherwise("same")
    )
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{n}") for c in cols for s, n in (("x", "left"), ("y", "right"))]
    return both.select(*keys, *sides, status.alias("status"))


def extreme_rows(df: DataFrame, by: list[str], column: str, how=F.max) -> DataFrame:
    """Rows that hold the extreme of their group, all of them when tied; a NULL key is a group.

    The extremes come from an aggregate that combines in the map tasks and join
    back, so no task has to hold a whole group.
    """
    extremes = df.groupBy(*by).agg(how(column).alias("_extreme"))
    return null_safe_join(df, extremes, by, "inner").where(F.col(column) == F.col("_extreme")).drop("_extreme")


def last_n(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` rows with the greatest values: a top-k, not a full sort."""
    return df.orderBy(F.desc_nulls_last(column)).limit(n)


def split_and_append(df: DataFrame, condition, change) -> DataFrame:
    """Change the rows that meet a condition and put them back with the rest."""
    chosen = F.coalesce(condition, F.lit(False))
    return df.where(~chosen).unionByName(change(df.where(chosen)))
