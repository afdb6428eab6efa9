"""Fingerprints against a plain version, and likeness against true Jaccard likeness."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelkit.llm import fingerprints as fp
from panelkit.llm.queries import QUERIES

EMPTY = "0" * (fp.BINS * fp.BITS // 4)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plain_code(hashes):
    """Binning and borrowing on plain numbers; ``hashes`` are signed, as Spark gives them."""
    best = {}
    for h in hashes:
        b = (h & (1 << 64) - 1) >> 64 - 7
        best[b] = min(best.get(b, h), h)
    return best


def test_bins_hold_the_least_hash_of_each(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(-2**63, 2**63) for _ in range(n)],) for n in (0, 1, 5, 100, 2000)]
    out = spark.createDataFrame(rows, "h array<bigint>").select("h", fp.bins(F.col("h")).alias("b"), fp.densified(fp.bins(F.col("h"))).alias("d"))
    for r in out.collect():
        best = plain_code(r.h)
        assert {i: v for i, v in enumerate(r.b) if v is not None} == best
        assert len(r.d) == (fp.BINS if best else 0)
        assert all(r.d[i] == v for i, v in best.items()) and set(r.d) <= set(best.values())


def test_borrowing_depends_on_the_bin_alone(spark):
    """Two texts whose full bins are the same borrow alike."""
    h = [(b << 57) - (1 << 64 if b >= 64 else 0) for b in (0, 3, 64, 127)]
    out = [r.d for r in spark.createDataFrame([(h,), ([x + 1 for x in h],)], "h array<bigint>").select(
        fp.densified(fp.bins(F.col("h"))).alias("d")).collect()]
    assert [x + 1 for x in out[0]] == out[1] and len(set(out[0])) == 4


def test_shingles_need_five_words(spark):
    texts = ["", " \n", "a", "a b c d", "a b c d e", "a  b\tc d e f"]
    sizes = [r.n for r in frame(spark, texts).orderBy("doc_id").select(F.size(fp.shingle_hashes(F.col("text"))).alias("n")).collect()]
    assert sizes == [0, 0, 1, 1, 1, 2]


def test_likeness_is_near_the_true_one(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows, truth = [], []
    for keep in (0, 300, 600, 900, 1200, 1500):
        a, b = words[:1500], words[1500 - keep:3000 - keep]
        sa, sb = ({tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        rows.append((" ".join(a), " ".join(b)))
        truth.append(len(sa & sb) / len(sa | sb))
    df = spark.createDataFrame(rows, "a string, b string")
    found = [r.v for r in df.select(fp.likeness(fp.codes(F.col("a")), fp.codes(F.col("b"))).alias("v")).collect()]
    assert found[-1] == 1.0 and all(0 <= v <= 1 for v in found)
    assert all(abs(v - t) < 0.15 for v, t in zip(found, truth))
    assert sum(abs(v - t) for v, t in zip(found, truth)) / len(truth) < 0.05


def test_rows_of_every_kind(spark):
    rows = [(3, "one two three four five six", "x"), (3, "one two three four five six", "x"), (2, None, None), (2, "", "y"), (None, "ab", "z"), (9, "éß 𝒳 zz", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    out = fp.compare_edited(docs).collect()
    assert len(out) == 6
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.edited for r in by[9]] == ["éß 𝒳" + "one"]  # 7 characters, 3 of them replaced
    assert {r.edited for r in by[3]} == {"one two three "}  # followed by an empty text
    assert {r.edited for r in by[2]} == {""} and {r.fingerprint for r in by[2]} == {EMPTY}
    assert {r.near_edited for r in by[2]} == {1.0}
    assert by[None][0].edited == "aé"  # the last is followed by the first
    assert fp.compare_edited(docs.limit(0)).collect() == []
    alone = fp.compare_edited(docs.where("doc_id = 9")).collect()
    assert [r.edited for r in alone] == ["éß 𝒳éß "] and alone[0].near_next == 1.0


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_the_query_on_whole_documents(spark, partitions):
    d = "/root/testdata/sf0.01"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        mine = {r.doc_id: r for r in QUERIES["op10_document_fingerprints"](spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()), reverse=True)
    assert len(mine) == len(docs)
    sets = [set() for _ in docs]
    for i, (_, text) in enumerate(docs):
        w = text.encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    error = []
    for i, (doc_id, text) in enumerate(docs):
        follower = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + follower[:half]
        r = mine[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        w = edited.encode().split()
        se = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for found, other in ((r.near_edited, se), (r.near_next, sets[(i + 1) % len(docs)])):
            true = len(sets[i] & other) / len(sets[i] | other) if sets[i] | other else 1.0
            error.append(abs(found - true))
    assert sum(error) / len(error) < 0.05 and max(error) < 0.5
    same = {}
    for doc_id, text in docs:
        same.setdefault(text, set()).add(mine[doc_id].fingerprint)
    assert all(len(v) == 1 for v in same.values())
