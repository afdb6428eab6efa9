"""What counts as published.

Data are written to folders with names of their own. They count from the moment when
a ledger beside them names them: its entries are committed as one file, so readers
see all entries of a commit or none. A job that ends before its commit leaves a
folder that no entry names and no reader sees; it can be run again at any time.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_ledger"


def fresh_path(base: str, name: str) -> str:
    """A folder below ``base`` that nobody has written to."""
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def commit(entries: DataFrame, base: str) -> None:
    """Add entries to the ledger of ``base``, all of them or none.

    There is an entry per published part, a handful of rows, so one file holds
    them; ``_at`` and ``_commit`` tell commits apart.
    """
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    stamped = entries.withColumns({"_at": F.lit(now).cast("timestamp"), "_commit": F.lit(uuid.uuid4().hex)})
    stamped.coalesce(1).write.mode("append").parquet(f"{base.rstrip('/')}/{FOLDER}")


def entries(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """All entries of the ledger; none if nothing has been published."""
    full = f"{schema}, _at timestamp, _commit string"
    try:
        return spark.read.schema(full).parquet(f"{base.rstrip('/')}/{FOLDER}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def one_commit(found: DataFrame, by: list[str], first: bool = False) -> DataFrame:
    """For each key the entries of its newest commit, or of its first."""
    pick = F.min_by if first else F.max_by
    chosen = found.groupBy(*by).agg(pick("_commit", F.struct("_at", "_commit")).alias("_commit"))
    return found.join(chosen, [*by, "_commit"], "left_semi")
