"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import rebalanced
from panelkit.sources import ledger

RUN = "run_id string, path string"
DELIVERABLE = "snapshot_date date, name string, path string"


def write_table(df: DataFrame, path: str, partition_by=(), mode: str = "overwrite") -> None:
    """Parquet, optionally by partition columns, in files of even size."""
    rebalanced(df, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_snapshot(df: DataFrame, base: str, name: str, date: str) -> None:
    """Add or replace one dated snapshot of a deliverable; others stay."""
    (
        df.withColumn("snapshot_date", F.lit(date).cast("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(f"{base}/{name}")
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append report rows without a header, quotes doubled."""
    df.write.mode("append").option("header", False).option("escape", '"').csv(path)


def append_once(df: DataFrame, base: str, run_id: str) -> bool:
    """Append a run's report rows without a header, unless the run has been appended before; whether it was added.

    A run that ended before its commit has left rows that nobody reads, and can be
    repeated. Of two that commit at the same time, readers take the first.
    """
    spark = df.sparkSession
    if not ledger.entries(spark, base, RUN).where(F.col("run_id") == run_id).isEmpty():
        return False
    path = ledger.fresh_path(base, "rows")
    append_log(df, path)
    ledger.commit(spark.createDataFrame([(run_id, path)], RUN), base)
    return True


def write_deliverables(frames: dict[str, DataFrame], base: str, date: str) -> DataFrame:
    """Write the deliverables of a day to new folders, which nobody reads yet; their entries for the ledger."""
    spark = next(iter(frames.values())).sparkSession
    paths = {name: ledger.fresh_path(base, name) for name in frames}
    for name, df in frames.items():
        df.write.parquet(paths[name])
    rows = spark.createDataFrame([(date, n, p) for n, p in paths.items()], "snapshot_date string, name string, path string")
    return rows.withColumn("snapshot_date", F.col("snapshot_date").cast("date"))


def publish_snapshot(frames: dict[str, DataFrame], base: str, date: str) -> None:
    """Publish the deliverables of a day together: readers see all of them, or those that the day had before."""
    ledger.commit(write_deliverables(frames, base, date), base)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions of all models as one table, a partition per group."""
    write_table(df, path, partition_by=("state", "alert_type"))
