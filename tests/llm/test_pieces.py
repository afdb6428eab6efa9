"""Encoding and decoding against the library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import pieces
from panelkit.llm.queries import PIECE_MODEL, QUERIES


@pytest.fixture(scope="module")
def encoder():
    return pieces.loaded(PIECE_MODEL)


parts = st.sampled_from(["a", "b", "the", " ", "  ", " " * 7, "\n", "é", "ing", "▁", "0", "İ", "==", "-", "\t", "𝒳", "\x00", "<0x0A>", "</s>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(parts, max_size=30).map("".join) | st.text(max_size=40))
def test_ids_equal_the_librarys(text):
    encoder = pieces.loaded(PIECE_MODEL)
    ids = encoder.encode(text)
    assert ids == encoder.processor.encode(text)
    assert encoder.decode(ids) == encoder.processor.decode(ids)


def test_long_texts_and_texts_without_spaces(encoder):
    for text in ("=-" * 3000, "a" * 20_000, " " * 5000 + "x", "0123456789" * 2000, "ab\n" * 9000, "mixed ßüé words, " * 9000):
        assert encoder.encode(text) == encoder.processor.encode(text)


def test_full_caches_change_nothing(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 10)
    fresh = pieces.PieceEncoder(PIECE_MODEL)
    text = " ".join(f"word{i % 37} tion{i % 11}" for i in range(400))
    assert fresh.encode(text) == encoder.processor.encode(text)
    assert len(fresh.segments) <= 10 and len(fresh.older) <= 10


def test_rows_of_every_kind(spark):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (None, None, "y"), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode_decode(docs, PIECE_MODEL)
    assert out.columns == ["doc_id", "ids", "decoded"]
    found = sorted(((r.doc_id, r.ids, r.decoded) for r in out.collect()), key=str)
    hello = pieces.loaded(PIECE_MODEL).processor.encode("Hello  world")
    assert found == sorted([(1, hello, "Hello  world")] * 2 + [(None, [], ""), (2, [], "")], key=str)
    empty = hashlib.sha256(b"").hexdigest()
    digest = {r.doc_id: r for r in pieces.digests(out).collect()}[2]
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (0, empty, empty)
    assert pieces.encode_decode(docs.limit(0), PIECE_MODEL).collect() == []


def test_the_query_on_whole_documents(spark, encoder):
    d, sp = "/root/testdata/sf0.01", encoder.processor
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = sp.encode(r.text or "")
        expected.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(tuple(r) for r in QUERIES["op1_sentencepiece"](spark, d).collect()) == sorted(expected)
