"""Archives: records, revisits, and version lines inside payloads."""

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from panelkit.llm import warc

INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
SCHEMA = "page_id long, url string, html string, payload string, record_type string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        text = html or ""
        same = [p for p, _, h in rows if (h or "") == text and p is not None]
        last = max(same, default=None)
        revisit = last is not None and (page_id is None or page_id < last) and len(text.encode()) >= least
        out.append((page_id, len(text.encode()), digest(text), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.de/", "<p>é𝒳</p>"), (2, None, "<p>é𝒳</p>"), (3, "http://x\r\nWARC/1.0\r\n", None), (4, "u", ""),
    (5, "u", f"x {INNER} y"), (6, "u", INNER), (7, "u", "WARC/1.0\r\n"), (8, "u", "a\r\n\r\nWARC/1.0\r\nWARC/1.0\r\n"), (9, "u", "z" * 300_000),
    (10, "u", INNER * 50), (11, "u", "tail WARC/1.0\r"), (11, "u", "tail WARC/1.0\r"), (None, "u", "no key"), (12, "u", "\r\n\r\n"),
    (13, "u", "Content-Length: 9\r\n\r\n"), (14, "u", INNER.replace(": 3", ": 99999")),
]


@pytest.mark.parametrize("least", [0, 12])
def test_roundtrip(spark, least):
    out = warc.roundtrip(pages_of(spark, ROWS), least)
    assert sorted((tuple(r) for r in out.collect()), key=str) == expected(ROWS, least)


def test_no_pages(spark):
    assert warc.roundtrip(pages_of(spark, [])).collect() == []


@pytest.mark.parametrize("split", ["64", "1000", "100000"])
def test_files_cut_into_blocks(spark, tmp_path, split):
    """Uncompressed files are read in blocks; the chain runs across them."""
    path = str(tmp_path / "w")
    rows = [r for r in ROWS if r[0] is not None and r[0] != 9]
    warc.write(pages_of(spark, rows).coalesce(1), path, compression="none", records=7)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, split)
    try:
        back = warc.read(spark, path).collect()
    finally:
        spark.conf.set(name, before)
    html = {}
    for page_id, _, text in rows:
        html.setdefault(page_id, text or "")
    assert sorted(int(r.record_id) for r in back) == sorted(r[0] for r in rows)
    assert all(bytes(r.payload).decode() == html[int(r.record_id)] for r in back if r.record_type == "response")


def test_the_files_are_archives(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages_of(spark, ROWS[:6]), path)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path).glob("*.gz")))
    count = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.0\r\nWARC-Type: ")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        length = int(fields[b"Content-Length"])
        assert rest[length:length + 4] == b"\r\n\r\n"
        raw, count = rest[length + 4:], count + 1
    assert count == 6


def test_a_broken_chain_ends_there(spark, tmp_path):
    whole = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{}>\r\nContent-Length: {}\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes("".join([whole.format(1, 3), whole.format(2, 3), whole.format(3, 1), whole.format(4, 3)]).encode())
    back = warc.read(spark, str(tmp_path)).collect()
    assert sorted(int(r.record_id) for r in back) == [1, 2, 3]


def test_a_long_chain(spark, tmp_path):
    n = 1500
    rows = [(i, "u", f"<p>{i}</p>" + (INNER if i % 3 else "")) for i in range(n)]
    warc.write(pages_of(spark, rows).coalesce(1), str(tmp_path / "w"), records=10**6)
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert {int(r.record_id): bytes(r.payload).decode() for r in back} == {i: h for i, _, h in rows} and len(back) == n
