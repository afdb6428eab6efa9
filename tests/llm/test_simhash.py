"""Fingerprints and components against plain versions."""

import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkit.llm import simhash
from panelkit.llm.components import connected


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def plain_components(fps, distance=4):
    """Smallest index reachable by links, for each fingerprint."""
    x = np.array(fps, dtype=np.int64).view(np.uint64)
    label = np.arange(len(x))
    while True:
        new = np.array([label[np.bitwise_count(x ^ v) <= distance].min() for v in x])
        new = new[new]
        if np.array_equal(new, label):
            return label.tolist()
        label = new


@pytest.mark.parametrize("text", [
    "", " \n\t", "One", "a b c", "A b C d", "a b c d e", "É é  x y Z", "x " * 500, "naïve A\x0bB\x0cC d e f",
])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_a_very_long_text():
    start = time.time()
    text = " ".join(f"w{i % 9973}" for i in range(600_000))
    assert simhash.fingerprint(text) == plain_fingerprint_numpy(text)
    assert time.time() - start < 60


def plain_fingerprint_numpy(text):
    w = text.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i:i + 4]), 42) for i in range(len(w) - 3)], dtype=np.uint64)
    bits = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    return bits - (1 << 64) if bits >> 63 else bits


def clustered(n, seed):
    """Random patterns, some of them a few bits from another, so that chains and balls arise."""
    rng = np.random.default_rng(seed)
    out = [int(v) for v in rng.integers(0, 1 << 63, n, dtype=np.int64)]
    for i in range(n // 4, n):
        base = out[rng.integers(0, i)] if i % 3 else out[0]
        for bit in rng.choice(63, rng.integers(1, 7), replace=False):
            base ^= 1 << int(bit)
        out[i] = base
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("chunk, group", [(2048, 2048), (32, 2048), (64, 1)])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, chunk, group):
    """Also with groups dealt to several tasks, and with more blocks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "GROUP", group)
    fps = clustered(1500, seed=chunk)
    df = spark.createDataFrame([(v,) for v in fps], "fp long").repartition(5)
    found = simhash.links(df, len(fps) if group > 1 else 20_000).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") >= 1 for a, b in found)
    place = {v: i for i, v in enumerate(fps)}
    label = connected(spark.createDataFrame(found, "a long, b long")).collect()
    mine = {place[r.node]: place[r.label] for r in label}
    mine = [mine.get(i, i) for i in range(len(fps))]
    theirs = plain_components(fps)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.choose_blocks(n) for n in (0, 10**6, 10**8, 10**11)] == [5, 5, 6, 7]
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(blocks)
        assert all(bin(m).count("1") >= 64 // blocks * (blocks - 4) for m in masks)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [
        (5, base, "x"), (3, base + " end", "x"), (9, None, "x"), (8, "", None), (8, "", None), (7, "Only two", "y"), (None, "only TWO", "y"),
        (None, "another text here", "z"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("label", F.lit(1))
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (8, 8), (7, 7), (None, 7), (None, None)], key=str)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_the_query_on_whole_documents(spark):
    from panelkit.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    docs = sorted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain_fingerprint(r.text) for r in docs]
    expected = [
        (r.doc_id, f"{fp & (1 << 64) - 1:016x}", docs[c].doc_id) for r, fp, c in zip(docs, fps, plain_components(fps))
    ]
    assert sorted(tuple(r) for r in QUERIES["op5_simhash_neardup"](spark, d).collect()) == expected
