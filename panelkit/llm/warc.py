"""WARC archives (operator 8): written with revisits, read by a verified chain of records.

Writing: a record per page, as text files whose records end in two line breaks.
Pages with equal payloads (the same SHA-1 digest and length) share one response,
the one with the largest key; the others become revisit records without payload.

Reading: each file is cut at every occurrence of the version line, wherever a
task happens to meet one. A piece is only a candidate: it may lie inside a payload.
Tasks emit for each candidate its offset and that of the successor which its
header promises. Starting with the offset 0 of each file, pointers are jumped in
doubled steps until the chain has ended; candidates that it never reaches are not
records but part of the payload before them, and are put back there.

Defined results: a NULL or empty payload is an empty block; NULL keys are written
as an empty id and read back as NULL; rows that repeat the key and the payload of
a response are responses themselves; line breaks in an address are dropped, and its ``WARC/`` is percent-encoded; a file
whose chain breaks gives the records up to the break.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.session import shared_path, stage

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive file, about.
RECORDS = 1000


def base32_sha1(payload: Column) -> Column:
    """SHA-1 digest in upper-case base 32, as WARC headers carry it."""
    alphabet = F.array(*[F.lit(sign) for sign in BASE32])

    def signs(bits: Column) -> Column:
        return F.concat(*[F.element_at(alphabet, F.shiftright(bits, s).bitwiseAND(31) + 1) for s in (15, 10, 5, 0)])

    def spelled(digest: Column) -> Column:  # 5 hex digits are 20 bits, and those 4 signs
        starts = F.array(*[F.lit(i) for i in range(1, 41, 5)])
        bits = F.transform(starts, lambda i: F.conv(F.substring(digest, i, F.lit(5)), 16, 10).cast("int"))
        return F.array_join(F.transform(bits, signs), "")

    # Bound as a lambda's argument, the digest is taken once, not once for each sign.
    return F.element_at(F.transform(F.array(F.sha1(payload)), spelled), 1)


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with digest, length, ``record_type`` and ``refers_to``.

    Only digests and keys are grouped; the page contents move once, when they
    join the table of digests.
    """
    counted = pages.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    last = counted.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"))
    last = stage(last, "payloads")
    older = (F.col("page_id") < F.col("last")) | (F.col("page_id").isNull() & F.col("last").isNotNull())
    revisit = F.coalesce(older, F.lit(False)) & (F.col("payload_bytes") >= least)
    return counted.join(last, ["payload_digest", "payload_bytes"]).select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last")).alias("refers_to"),
    )


def record_text(typed: DataFrame) -> DataFrame:
    """The text of each record, without the two line breaks that end it."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    refers = F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">\r\n"))).otherwise("")
    # A version line within a header would cut it, so the address may not make one.
    address = F.replace(F.regexp_replace(text("url"), r"[\r\n]", ""), F.lit("WARC/"), F.lit("WARC%2F"))
    return typed.select(F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: <urn:page:"), text("page_id"),
        F.lit(">\r\nWARC-Target-URI: "), address, F.lit("\r\n"), refers,
        F.lit("WARC-Payload-Digest: sha1:"), "payload_digest", F.lit("\r\nX-Payload-Bytes: "), text("payload_bytes"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BREAK), body,
    ).alias("value"))


def write(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
    records: int = RECORDS, compression: str = "gzip",
) -> None:
    """Write pages as archives below ``path``, about ``records`` of them in a file."""
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    text = record_text(with_types(own, least))
    text.write.option("lineSep", BREAK).option("compression", compression).option("maxRecordsPerFile", records).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two version lines: ``file``, ``block`` and the text (``value``)."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def placed(parts: DataFrame) -> DataFrame:
    """Adds ``rel``: the bytes of the block's pieces before this one.

    A task meets the pieces of a block in their order, so a running sum does it.
    """
    sized = parts.withColumn("_size", F.octet_length("value") + len(MAGIC)) if "_size" not in parts.columns else parts
    fields = ", ".join(f"{n} {t}" for n, t in sized.dtypes)

    def run(batches):
        here, done = None, 0
        for batch in batches:
            size = batch.column("_size").to_numpy().astype(np.int64)
            spots = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
            turns = [i for i, spot in enumerate(spots) if spot != (spots[i - 1] if i else here)]
            before = np.cumsum(size) - size
            rel = before + done
            for i in turns:
                rel[i:] = before[i:] - before[i]
            if len(size):
                here, done = spots[-1], int(rel[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rel)], names=[*batch.schema.names, "rel"])

    return sized.mapInArrow(run, f"{fields}, rel long")


def header(name: str) -> Column:
    """A field of the header; empty if it is not there."""
    head = F.concat(F.lit("\r\n"), F.substring_index("value", BREAK, 1), F.lit("\r\n"))
    return F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1)


def head_bytes() -> Column:
    """Bytes of the header with the break that ends it; NULL without one."""
    return F.when(F.instr("value", BREAK) > 0, F.octet_length(F.substring_index("value", BREAK, 1)) + len(BREAK))


def candidates(parts: DataFrame) -> DataFrame:
    """Per piece its place, its offset in the file and the successor that its header promises."""
    stated = F.expr("try_cast(_length AS BIGINT)")
    length = F.when(stated >= 0, stated)
    slim = parts.select(
        "file", "block", (F.octet_length("value") + len(MAGIC)).alias("_size"), head_bytes().alias("head"), header("Content-Length").alias("_length"),
    )
    slim = stage(placed(slim).withColumn("length", length).drop("_length"), "pieces")
    blocks = slim.groupBy("file", "block").agg(F.max(F.col("rel") + F.col("_size")).alias("bytes"))
    base = F.coalesce(F.sum("bytes").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = stage(blocks.select("file", "block", base.alias("base")), "blocks")
    # A piece begins after a version line, so the line itself is that much before it.
    begin = F.col("base") + F.col("rel") - len(MAGIC)
    return stage(slim.join(bases, ["file", "block"]).select(
        "file", "block", "rel", begin.alias("start"), F.col("_size").alias("size"), "head", "length",
        (begin + len(MAGIC) + F.col("head") + F.col("length") + len(BREAK)).alias("next"),
    ).where("start >= 0"), "candidates")


def reachable(found: DataFrame) -> DataFrame:
    """Offsets (``file``, ``start``) on the chain from the start of each file, by pointer jumping.

    In each round a reached candidate marks the one its pointer leads to, and every
    pointer is replaced by the pointer of where it leads. After k rounds the first
    2^k records are marked, so rounds grow with the logarithm of a file's records.
    """
    state = found.select("file", "start", F.col("next").alias("jump"), (F.col("start") == 0).alias("reached"))
    while not state.where("reached and jump is not null").isEmpty():
        there = state.select("file", F.col("start").alias("jump"), F.col("jump").alias("further"), F.lit(True).alias("real"))
        joined = state.join(there, ["file", "jump"], "left")
        # Each row stands for itself with its doubled pointer, and marks its target if it is reached.
        own = F.struct("start", F.col("further").alias("jump"), "reached")
        target = F.when(F.col("reached") & F.col("real"), F.struct(
            F.col("jump").alias("start"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("reached")))
        rows = joined.select("file", F.explode(F.array_compact(F.array(own, target))).alias("r")).select("file", "r.*")
        state = stage(rows.groupBy("file", "start").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached")), "reached")
    return state.where("reached").select("file", "start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: header fields and ``payload`` (binary).

    Pieces that are whole records pass without a shuffle, but for those that are
    not records at all; only records cut by a version line in their payload are
    put together from their pieces.
    """
    parts = pieces(spark, path)
    found = candidates(parts)
    chain = stage(reachable(found).withColumn("record", F.lit(True)), "chain")
    marked = stage(found.join(chain, ["file", "start"], "left").withColumn("record", F.coalesce("record", F.lit(False))), "marked")
    whole = F.col("head") + F.col("length") <= F.col("size") - len(MAGIC)
    # Pieces that do not stand for themselves: no records, or records that go on in later pieces.
    cut = marked.where(~F.col("record") | ~F.coalesce(whole, F.lit(False)))
    owner = F.last(F.when(F.col("record"), F.col("start")), True).over(W.partitionBy("file").orderBy("start"))
    cut = stage(cut.withColumn("owner", owner).select("file", "block", "rel", "start", "owner"), "cut")
    text = placed(parts)
    standing = text.join(cut, ["file", "block", "rel"], "left_anti").where((F.col("block") > 0) | (F.col("rel") > 0))
    apart = text.join(cut.where("owner is not null"), ["file", "block", "rel"]).groupBy("file", F.col("owner").alias("start")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), MAGIC).alias("value")
    )
    return standing.select("value").unionByName(apart.select("value")).select(
        header("WARC-Type").alias("record_type"), F.regexp_extract(header("WARC-Record-ID"), "<urn:page:(.*)>", 1).alias("record_id"),
        header("WARC-Target-URI").alias("url"), F.nullif(F.regexp_extract(header("WARC-Refers-To"), "<urn:page:(.*)>", 1), F.lit("")).alias("refers_to"),
        F.regexp_extract(header("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("stated_digest"),
        header("X-Payload-Bytes").alias("stated_bytes"),
        F.substring(F.col("value").cast("binary"), head_bytes() + 1, header("Content-Length").cast("int")).alias("payload"),
    )


def roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and describe each record."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write(pages, path, least=least)
    back = read(spark, path)
    response = F.col("record_type") == "response"
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') AS BIGINT)")
    return back.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(number("stated_bytes")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
