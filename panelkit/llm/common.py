"""What the text operators share: reading columns, and passing rows to Python in bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows at a time of a batch that holds whole texts.
TEXT_ROWS = 256
WORD_GAP = r"[\x20\x09-\x0D]+"


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and whole text alone, a NULL text as an empty one.

    Other columns of ``docs`` stay behind here, so none of them can clash with
    the columns that an operator adds.
    """
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def in_batches(
    rows: DataFrame, schema: str, handle: Callable[[list[dict]], dict[str, object]], start: Callable[[], object] | None = None
) -> DataFrame:
    """Rows through ``handle``, a few hundred at a time; it returns columns of ``schema``.

    However many rows Spark puts in an Arrow batch, what Python holds as objects
    at once is ``TEXT_ROWS`` rows. ``start``, if given, runs once a task and its
    value is the second argument of ``handle``.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None if start is None else start()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(at, TEXT_ROWS)
                columns = {name: part.column(name) for name in part.schema.names}
                out = handle(columns) if start is None else handle(columns, state)
                yield pa.RecordBatch.from_arrays(
                    [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in ((out[f.name], f) for f in fields)],
                    schema=fields,
                )

    return rows.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column | str) -> Column:
    """The words of a text: runs of anything but ASCII white space; none for NULL."""
    parts = F.split(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def slices(batch: pa.RecordBatch, text: str, rows: int = 1024, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many rows and so many bytes of text, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, upto - at)
        at = upto


def own_name(wanted: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
