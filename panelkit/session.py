"""Session settings and the staging of shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def build_session(app: str = "panelkit", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: the setting, or the context's own.

    Only a local session may fall back on a temporary folder. On a cluster each
    executor would write to its own disk, so a missing folder is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="panelkit-")
    return _own_folder[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under a folder of this application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; frames read from it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rebalanced(df: DataFrame, columns) -> DataFrame:
    """Rows brought together by columns, in partitions of even size.

    Adaptive execution splits a value that holds too many rows over several
    tasks, and puts small ones together.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns]) if columns else df


def stage(df: DataFrame, name: str = "stage", partition_by=()) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    For a result that several branches of one job use. The written table cuts
    the lineage, survives the loss of executors, and keeps the raw scan from
    being repeated per branch.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    rebalanced(df, partition_by).write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
