"""Dense numbers for the values of a column, however many there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.operators.keys import null_safe_join
from panelkit.session import stage


def dense_ids(df: DataFrame, by: list[str], column: str, name: str = "id") -> DataFrame:
    """Distinct values of a column per group, numbered from 0 in their order; NULL has no number.

    The values are dealt out by range. A value's number is the count of its group's
    values in the partitions before its own, plus its place within the group's part
    of the partition. No task holds a whole group, and none of the values comes to
    the driver.
    """
    values = df.select(*by, column).where(F.col(column).isNotNull()).distinct()
    ranged = values.repartitionByRange(*by, column).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged.withColumn("_group", F.struct(*by) if by else F.struct(F.lit(0).alias("all"))), "values")
    sizes = ranged.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # A row per group and partition, so a group has as many as there are partitions at most.
    before = W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_group", "_part").orderBy(column)
    numbered = ranged.join(offsets, ["_group", "_part"])
    return numbered.select(*by, column, (F.col("_before") + F.row_number().over(within) - 1).alias(name))


def encode(df: DataFrame, ids: DataFrame, by: list[str], column: str, name: str, id_name: str = "id") -> DataFrame:
    """Rows with the number of their value; NULL for a value (or group) that the dictionary lacks."""
    return null_safe_join(df, ids.withColumnRenamed(id_name, name), [*by, column])


def decode(df: DataFrame, ids: DataFrame, by: list[str], name: str, column: str, id_name: str = "id") -> DataFrame:
    """Rows with the value of their number; NULL for a number that the dictionary lacks."""
    return null_safe_join(df, ids.withColumnRenamed(id_name, name), [*by, name])


def sizes(ids: DataFrame, by: list[str], id_name: str = "id") -> DataFrame:
    """Numbers in use per group."""
    return ids.groupBy(*by).agg((F.max(id_name) + 1).alias("n_values"))


def position(column: str, values: list[str]) -> Column:
    """The place of a value in a short fixed list, counted from 0; NULL for any other."""
    spot = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(spot > 0, spot - 1)
