"""Token ids as length-delimited binary records with an offset index (operator 11).

A record is the length of its data (8 bytes), the masked CRC-32C of that length (4),
the data, and the masked CRC-32C of the data (4), all little-endian; here the data
are ids of 2 bytes each, or of 4 where the vocabulary needs them. Records stand one after the other in shards, which together
hold the documents in ascending order of their key.

Writing sorts the texts by range, so that each task encodes a stretch of keys and
writes it to shards of its own. The index is a table with a row per record: key,
shard, offset, bytes, bytes of an id, the shard's number, and the ids before it in the shard. Spark commits the index,
and only what it names counts: a shard of a failed or repeated attempt has a name of
its own and is in no index. Reading takes rows of the index, in any order and from
any task, fetches their bytes, and checks lengths and both checksums; it fails on
data that do not fit.

Defined results: a NULL or empty text is a record with the end id alone; keys that
are NULL come first; rows with equal keys are ordered by their text's hash, and
repeated rows come in any order; no rows give an index without rows. The folder has
to be reachable by the same address from all machines through pyarrow's file systems
(a shared mount, HDFS, S3, GCS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bytepairs
from panelkit.llm.checksums import crc32c, masked
from panelkit.llm.common import slices, texts
from panelkit.operators.ranks import running_totals
from panelkit.session import shared_path

#: A shard is closed when it has so many bytes; a task's last shard may be smaller.
SHARD_BYTES = 64 << 20
#: Most bytes that a task fetches at once, unless a single record has more.
FETCH_BYTES = 4 << 20
#: Bytes around the data of a record.
AROUND = 16


def _halves(values: np.ndarray, count: int) -> np.ndarray:
    """Whole numbers as ``count`` units of 16 bits each, the lowest first."""
    return np.ascontiguousarray(values, f"<u{2 * count}").view("<u2").reshape(-1, count)


def _heads(bytes_: np.ndarray) -> np.ndarray:
    """Length and its checksum for records with so many bytes of data, six units each."""
    length = _halves(bytes_.astype(np.uint64), 4)
    check = masked(crc32c(length.ravel(), np.arange(0, 4 * len(length) + 1, 4)))
    return np.hstack([length, _halves(check, 2)])


def framed(units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of messages ``units[ends[i]:ends[i + 1]]`` of 16-bit units, and where each record ends."""
    size = np.diff(ends)
    upto = np.r_[0, np.cumsum(size + AROUND // 2)]
    out = np.empty(upto[-1], np.uint16)
    out[upto[:-1, None] + np.arange(6)] = _heads(size * 2)
    out[np.arange(len(units)) + np.repeat(upto[:-1] + 6 - ends[:-1], size)] = units
    out[upto[1:, None] + np.arange(-2, 0)] = _halves(masked(crc32c(units, ends)), 2)
    return out, upto


def unframed(units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The data of records and where each ends, with all lengths and checksums checked."""
    size = np.diff(ends) - AROUND // 2
    if (size < 1).any():
        raise ValueError("a record without data")
    if (units[ends[:-1, None] + np.arange(6)] != _heads(size * 2)).any():
        raise ValueError("a record's length does not fit the index or its checksum")
    upto = np.r_[0, np.cumsum(size)]
    data = units[np.arange(upto[-1]) + np.repeat(ends[:-1] + 6 - upto[:-1], size)]
    if (units[ends[1:, None] + np.arange(-2, 0)] != _halves(masked(crc32c(data, upto)), 2)).any():
        raise ValueError("a record's data do not fit their checksum")
    return data, upto


def _opened(folder: str):
    """The file system that holds a folder, and the folder's path in it."""
    from pyarrow.fs import FileSystem

    scheme, colon, path = folder.partition(":")
    if not colon or scheme == "file":
        return FileSystem.from_uri("file:///" + (path or folder).lstrip("/"))
    return FileSystem.from_uri(folder)


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode whole texts, add ``end_id`` to each, and write them below ``folder`` in the order of the key."""
    kind = dict(docs.dtypes)[key]
    # Rows that repeat a key are still dealt to several tasks, by the text and then by the row.
    ordered = texts(docs, key, text).orderBy(
        F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bytepairs.loaded(tokenizer)
        width = 2 if max(encoder.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        system, base = _opened(folder)
        system.create_dir(f"{base}/shards", recursive=True)
        place = (TaskContext.get().partitionId() << 20) - 1
        shard, stream, offset, before = "", None, 0, 0
        try:
            for batch in batches:
                for rows in slices(batch, "text", 2048, 6 << 20):
                    ids, ends = encoder.encode(rows.column("text"))
                    own = np.diff(ends) + 1
                    full = np.full(len(ids) + len(own), end_id, np.uint32)
                    full[np.arange(len(ids)) + np.repeat(np.arange(len(own)), own - 1)] = ids
                    units, upto = framed(full.astype(f"<u{width}").view("<u2"), np.r_[0, np.cumsum(own)] * (width // 2))
                    if stream is None or offset >= shard_bytes:
                        if stream is not None:
                            stream.close()
                        place += 1
                        shard, offset, before = f"{place:015d}-{uuid.uuid4().hex}", 0, 0
                        stream = system.open_output_stream(f"{base}/shards/{shard}")
                    stream.write(units.astype("<u2").tobytes())
                    yield pa.RecordBatch.from_arrays([
                        rows.column("doc_id"), pa.array([place] * len(own), pa.int64()), pa.array([shard] * len(own)),
                        pa.array(offset + 2 * upto[:-1]), pa.array(2 * np.diff(upto)), pa.array([width] * len(own), pa.int32()),
                        pa.array(before + np.cumsum(own) - own),
                    ], names=["doc_id", "place", "shard", "offset", "bytes", "width", "before"])
                    offset, before = offset + 2 * int(upto[-1]), before + int(own.sum())
        finally:
            if stream is not None:
                stream.close()

    ordered.mapInArrow(run, f"doc_id {kind}, place long, shard string, offset long, bytes long, width int, before long").write.parquet(f"{folder}/index")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The records that were written: key, place, and ids before them in their shard."""
    return spark.read.parquet(f"{folder}/index")


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows of an index in an order by chance, the same for the same seed and number of partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset")


def read(rows: DataFrame, folder: str, fetch_bytes: int = FETCH_BYTES) -> DataFrame:
    """The records that the rows of an index name, with ``ids`` (binary): 4 bytes an id, little-endian.

    Neighbouring records are fetched at once, others one by one.
    """
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        name, file = None, None
        try:
            for batch in batches:
                shards = batch.column("shard").to_pylist()
                offset, size, width = (batch.column(c).to_numpy().astype(np.int64) for c in ("offset", "bytes", "width"))
                at = 0
                while at < len(shards):
                    upto, total = at + 1, size[at]
                    while upto < len(shards) and shards[upto] == shards[at] and offset[upto] == offset[upto - 1] + size[upto - 1] and (
                        width[upto] == width[at] and total + size[upto] <= fetch_bytes
                    ):
                        total += size[upto]
                        upto += 1
                    if shards[at] != name:
                        if file is not None:
                            file.close()
                        name, file = shards[at], system.open_input_file(f"{base}/shards/{shards[at]}")
                    found = file.read_at(int(total), int(offset[at]))
                    if len(found) != total:
                        raise ValueError(f"shard {name} ends within a record")
                    data, ends = unframed(np.frombuffer(found, "<u2"), np.r_[0, np.cumsum(size[at:upto])] // 2)
                    data, ends = data.astype("<u2").view(f"<u{width[at]}"), ends // (width[at] // 2)
                    column = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), upto - at, [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(data.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, upto - at).columns, column.cast(pa.binary())], names=[*batch.schema.names, "ids"])
                    at = upto
        finally:
            if file is not None:
                file.close()

    return rows.mapInArrow(run, f"{fields}, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """Rows of an index with ``start``, the ids of all records before theirs, in the order of the shards.

    ``place`` numbers the shards: that of the task, then that within the task.
    """
    totals = rows.groupBy("place").agg(F.sum((F.col("bytes") - AROUND) / F.col("width")).cast("long").alias("n"))
    bases = running_totals(totals, [], "place", ["n"]).select("place", (F.col("n_upto") - F.col("n")).alias("base"))
    return rows.join(bases, "place").withColumn("start", F.col("base") + F.col("before")).drop("base")


def roundtrip(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write texts to records in the shared folder and read them back: key, ids of all rows before, own ids."""
    spark = docs.sparkSession
    folder = shared_path(spark, "records")
    write(docs, folder, tokenizer, end_id, key, text)
    # The join moves rows of the index alone. They are dealt out by shard, so that each
    # task has about a shard's bytes to fetch; sorted again, neighbours are fetched at once.
    total = index(spark, folder).agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-total // SHARD_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_starts(index(spark, folder)).repartition(parts, "place").sortWithinPartitions("place", "offset")
    return read(rows, folder).select("doc_id", "start", "ids")
