"""Scans. Every text scan takes an explicit schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelkit.functions.text import legal_names
from panelkit.session import stage
from panelkit.sources import ledger
from panelkit.sources.writers import DELIVERABLE, RUN


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path, schema: str, null_value: str = "NA") -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", null_value)
        .option("escape", '"')
        .csv(path)
    )


def read_delimited(
    spark: SparkSession, path, schema: str, sep: str = ";", null_value: str = "..."
) -> DataFrame:
    """Text with its own separator and null token; the header line is replaced
    by the names of the schema."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("nullValue", null_value)
        .csv(path)
    )


def read_reference(spark: SparkSession, path, schema: str, key: str) -> DataFrame:
    """Reference sheet saved as text: legal names, footer rows cut by their NULL key."""
    return cut_footer(legal_names(read_csv(spark, path, schema)), key)


def cut_footer(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def read_models(spark: SparkSession, paths, schema: str) -> DataFrame:
    """All ``<model>_..._pred.csv`` files of a glob as one table, with the model."""
    name = F.regexp_extract(F.input_file_name(), r"/([^/_]+)_[^/]*_pred\.", 1)
    return read_csv(spark, paths, schema).withColumn("model", name)


def read_jdbc(
    spark: SparkSession, url: str, sql: str, *, split_on: str, lower, upper, parts: int, **options
) -> DataFrame:
    """SQL text sent to a database, read in ``parts`` ranges of ``split_on``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=f"({sql}) source", partitionColumn=split_on, **options)
        .options(lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
        .load()
    )


def read_snapshots(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All dated snapshots of one deliverable, with ``snapshot_date``."""
    return spark.read.parquet(f"{base}/{name}")


def latest_snapshot(snapshots: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot.

    The newest date is a scalar subquery, so the scan prunes its partitions.
    """
    newest = snapshots.agg(F.max(date)).scalar()
    return snapshots.where(F.col(date) == newest)


def read_snapshot(spark: SparkSession, base: str, name: str, date: str | None = None) -> DataFrame:
    """One deliverable as of ``date``, or its newest snapshot."""
    df = read_snapshots(spark, base, name)
    if date is None:
        return latest_snapshot(df)
    return df.where(F.col("snapshot_date") == F.lit(date).cast("date"))


def up_to(df: DataFrame, as_of, lag_days: int, date: str = "date") -> DataFrame:
    """Leave out the last days before ``as_of``, which are still filling up."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return df.where(F.col(date) <= F.date_sub(as_of, lag_days))


def read_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """SQL text over named DataFrames, which it refers to as ``{name}``."""
    return spark.sql(text, **tables)


def checked_csv(spark: SparkSession, path, schema: str, sep: str = ",", null_value: str = "NA", header: bool = True) -> DataFrame:
    """A text table with ``_record`` and ``_reason``, both NULL for a row that fits the schema.

    A row is malformed if it has too few or too many values, or a value that is not
    of its column's type; the reason names the first such column. Everything is
    read as text once, so that the values of a malformed row can be told.
    """
    kinds = StructType.fromDDL(schema)
    clash = {"_record", "_reason"} & set(kinds.names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names of their own here")
    texts = ", ".join(f"`{f.name}` string" for f in kinds)
    raw = (
        spark.read.schema(f"{texts}, _record string")
        .options(header=header, sep=sep, nullValue=null_value, escape='"', columnNameOfCorruptRecord="_record")
        .csv(path)
    )
    read = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in kinds}
    wrong = [F.when(F.col(f"`{n}`").isNotNull() & c.isNull(), F.lit(f"{n}: not {kinds[n].dataType.simpleString()}")) for n, c in read.items()]
    reason = F.when(F.col("_record").isNotNull(), "number of values").otherwise(F.coalesce(*wrong))
    text = F.to_csv(F.struct(*[F.col(f"`{n}`") for n in kinds.names]), {"sep": sep, "nullValue": null_value})
    return raw.select(
        *[c.alias(n) for n, c in read.items()],
        F.when(reason.isNotNull(), F.coalesce("_record", text)).alias("_record"), reason.alias("_reason"),
    )


def load_csv(spark: SparkSession, path, schema: str, side: str, sep: str = ",", null_value: str = "NA", header: bool = True) -> DataFrame:
    """The rows of a text table that fit the schema; the others are added to the table ``side`` with their reason.

    The text is read once; good and bad rows come from the same staged table.
    """
    rows = stage(checked_csv(spark, path, schema, sep, null_value, header), "checked")
    bad = rows.where(F.col("_reason").isNotNull())
    bad.select(F.col("_record").alias("record"), F.col("_reason").alias("reason")).write.mode("append").parquet(side)
    return rows.where(F.col("_reason").isNull()).drop("_record", "_reason")


def read_log(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The rows of all runs in a log that :func:`writers.append_once` has written."""
    runs = ledger.one_commit(ledger.entries(spark, base, RUN), ["run_id"], first=True)
    paths = sorted(r.path for r in runs.select("path").collect())  # one a run
    return spark.read.schema(schema).option("escape", '"').csv(paths) if paths else spark.createDataFrame([], schema)


def published(spark: SparkSession, base: str) -> DataFrame:
    """Days and deliverables of :func:`writers.publish_snapshot`: for each day those of its newest publication."""
    return ledger.one_commit(ledger.entries(spark, base, DELIVERABLE), ["snapshot_date"])


def read_published(spark: SparkSession, base: str, date: str | None = None) -> dict[str, DataFrame]:
    """All deliverables of a day, by default the newest, from one publication, with ``snapshot_date``."""
    found = published(spark, base)
    day = found.agg(F.max("snapshot_date")).scalar() if date is None else F.lit(date).cast("date")
    rows = found.where(F.col("snapshot_date") == day).collect()  # one a deliverable
    if not rows:
        raise ValueError(f"nothing is published in {base} for {date or 'any day'}")
    return {r.name: spark.read.parquet(r.path).withColumn("snapshot_date", F.lit(r.snapshot_date)) for r in rows}
