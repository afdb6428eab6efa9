"""Records: checksums bit by bit, files read by a plain reader, ids against the library."""

import struct
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelkit.llm import bytepairs, checksums, records, segments
from panelkit.llm.queries import BYTE_MODEL, QUERIES


@lru_cache(None)
def library(plain=False):
    own = Tokenizer.from_file(BYTE_MODEL)
    own.encode_special_tokens = plain
    return own


def plain_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ 0x82F63B78 if crc & 1 else crc >> 1
    return crc ^ 0xFFFFFFFF


def plain_mask(crc):
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def plain_records(data):
    """The data of each record of a file, from its lengths and checksums alone."""
    at, out = 0, []
    while at < len(data):
        length, = struct.unpack_from("<Q", data, at)
        head, = struct.unpack_from("<I", data, at + 8)
        assert head == plain_mask(plain_crc(data[at:at + 8]))
        own = data[at + 12:at + 12 + length]
        assert struct.unpack_from("<I", data, at + 12 + length)[0] == plain_mask(plain_crc(own))
        out.append(own)
        at += 16 + length
    assert at == len(data)
    return out


def test_checksum_of_a_known_message():
    assert plain_crc(b"123456789") == 0xE3069283
    for text in (b"12345678", b"12", b"1234", b"x" * 126, b"y" * 128, b"z" * 4000):
        units = np.frombuffer(text, "<u2")
        assert checksums.crc32c(units, np.array([0, len(units)])).tolist() == [plain_crc(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=12), st.integers(0, 2**32 - 1))
def test_checksums_of_many_messages(sizes, seed):
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    units = np.random.default_rng(seed).integers(0, 2**16, ends[-1], dtype=np.uint16)
    parts = [units[a:b].astype("<u2").tobytes() for a, b in zip(ends, ends[1:])]
    assert checksums.crc32c(units, ends).tolist() == [plain_crc(p) for p in parts]
    framed, upto = records.framed(units, ends)
    assert plain_records(framed.astype("<u2").tobytes()) == parts
    data, own = records.unframed(framed, upto)
    assert data.tolist() == units.tolist() and own.tolist() == ends.tolist()


pieces = st.sampled_from(["\x01", ".\nA", "a", "the", " ", "  ", "\n", "é", "\x1c", "᠎", " ", "'s", "<|endoftext|>", "1", "_", "。", "😀", "́", ".", ",", "?!", "É", "×"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=20).map("".join) | st.text(max_size=20), min_size=1, max_size=6), st.booleans())
def test_ids_equal_the_librarys(texts, plain):
    encoder = bytepairs.loaded(BYTE_MODEL, plain)
    ids, ends = encoder.encode(bytepairs.pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library(plain).encode(t, add_special_tokens=False).ids for t in texts]
    assert all("".join(segments.cut(t)) == t for t in texts)


def test_long_texts_and_full_tables(monkeypatch):
    monkeypatch.setattr(segments, "KEPT", 10)
    encoder = bytepairs.ByteEncoder(BYTE_MODEL)
    for text in ("a" * 20_000, " " * 5000 + "x", "word, " * 9000, "é\n" * 3000, " ".join(f"w{i % 37} tion{'x' * (i % 11)}" for i in range(500))):
        ids, _ = encoder.encode(bytepairs.pa.array([text]))
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def expected(rows, end_id=2):
    """Per row in the order of keys (NULL first): key, ids before it, its ids."""
    out, before = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library().encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((key, before, ids))
        before += len(ids)
    return out


def listed(df):
    return sorted(((r.doc_id, r.start, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in df.collect()), key=lambda r: r[1])


def test_rows_of_every_kind(spark):
    rows = [(None, "no key"), (2, "two"), (2, "two"), (5, None), (6, ""), (1, "x" * 5000), (9, "<|endoftext|> end")]
    docs = spark.createDataFrame([(k, t, "i", 0) for k, t in rows], "doc_id long, text string, ids string, start int").repartition(3)
    assert listed(records.roundtrip(docs, BYTE_MODEL, 2)) == expected(rows)
    assert records.roundtrip(docs.limit(0), BYTE_MODEL, 2).collect() == []


def test_one_key_for_all_rows_is_dealt_out(spark, tmp_path):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'the same text in every row' AS text").repartition(4)
    folder = f"file://{tmp_path}/one"
    records.write(docs, folder, BYTE_MODEL, 2)
    sizes = [r["count"] for r in records.index(spark, folder).groupBy("place").count().collect()]
    assert sum(sizes) == 4000 and (len(sizes) == 1 or max(sizes) < 3000)
    starts = sorted(r.start for r in records.with_starts(records.index(spark, folder)).collect())
    assert starts == [i * starts[1] for i in range(4000)]


def test_files_of_several_shards(spark, tmp_path):
    """A plain reader of the files, shard after shard, finds all ids; the index leads to each record in any order."""
    rows = [(k, f"document {k} " * (k % 50)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "files")
    records.write(docs, folder, BYTE_MODEL, 2, shard_bytes=20_000)
    data = [r for f in sorted(Path(folder, "shards").iterdir()) for r in plain_records(f.read_bytes())]
    wanted = expected(rows)
    assert [list(struct.unpack(f"<{len(d) // 2}H", d)) for d in data] == [ids for _, _, ids in wanted]
    index = records.index(spark, folder)
    assert index.select("place").distinct().count() == index.select("shard").distinct().count() > 1
    for seed in (1, 2):
        order = [r.doc_id for r in records.read(records.shuffled(index, seed), folder).collect()]
        assert sorted(order) == list(range(3000)) and order != sorted(order)
        assert order == [r.doc_id for r in records.read(records.shuffled(index, seed), folder).collect()]
    found = {r.doc_id: r.ids for r in records.read(records.shuffled(index, 3), folder, fetch_bytes=100).collect()}
    assert all(list(struct.unpack(f"<{len(found[k]) // 4}I", found[k])) == ids for k, _, ids in wanted)


def test_end_ids_above_16_bits_take_wider_records(spark, tmp_path):
    folder = str(tmp_path / "wide")
    records.write(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), folder, BYTE_MODEL, 70_000)
    found = {r.doc_id: r for r in records.read(records.with_starts(records.index(spark, folder)), folder).collect()}
    assert found[1].width == 4 and struct.unpack("<I", found[1].ids[-4:]) == (70_000,) and found[2].ids == struct.pack("<I", 70_000)
    assert found[2].start == len(found[1].ids) // 4


def test_damaged_files_fail(spark, tmp_path):
    folder = str(tmp_path / "damaged")
    records.write(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), folder, BYTE_MODEL, 2)
    shard, = Path(folder, "shards").iterdir()
    whole = shard.read_bytes()
    for at in (0, 9, 13, len(whole) - 1):
        shard.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1:])
        with pytest.raises(Exception, match="does not fit|do not fit"):
            records.read(records.index(spark, folder), folder).collect()
    shard.write_bytes(whole[:-4])
    with pytest.raises(Exception, match="ends within a record"):
        records.read(records.index(spark, folder), folder).collect()


def test_shards_that_no_index_names_do_not_count(spark, tmp_path):
    folder = str(tmp_path / "orphan")
    records.write(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), folder, BYTE_MODEL, 2)
    Path(folder, "shards", "000000000000000-of-an-attempt-that-failed").write_bytes(b"half a rec")
    assert records.read(records.index(spark, folder), folder).count() == 1


def test_the_query_on_whole_documents(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(k, s, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for k, s, ids in expected(rows)]
    assert sorted(tuple(r) for r in QUERIES["op11_token_records"](spark, d).collect()) == wanted
