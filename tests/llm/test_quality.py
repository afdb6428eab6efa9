"""Counts and verdicts; the query itself is held against its SQL with the others."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelkit.llm import quality

WHITE = r"[\x20\x09-\x0D]"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
    )


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é𝒳", " ", " ", "\n", "\t", "\x0b", "\x85", "\xa0", "#", "|"]), max_size=40).map("".join))
def test_counts(text):
    assert quality.base_counts(text, quality.words_of(text)) == plain_counts(text)


def test_a_long_text():
    text = " ".join(f"w{i % 70_000}" for i in range(200_000))
    assert quality.repeated_words(quality.words_of(text)) == 200_000


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(f"fine{rng.integers(8)}" for _ in range(80)) for _ in range(40)]
    junk = [" ".join(f"junk{rng.integers(10**6)} | " for _ in range(60)) for _ in range(15)]
    rows = [(i, t, "x", "y") for i, t in enumerate([*good, *junk])]
    rows += [(90, None, "x", "y"), (91, "", "x", "y"), (92, "too short", "x", "y"), (93, "same words again " * 40, "x", "y"), (None, good[0], "x", "y"), (5, good[5], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, score string")
    labels = spark.createDataFrame([*[(i, 1) for i in range(30)], *[(i, 0) for i in range(40, 50)], (None, 1), (3, 1), (77, None)], "doc_id long, quality int")
    return docs, labels


def test_verdicts(corpus):
    docs, labels = corpus
    out = quality.judge(docs, labels).collect()
    assert len(out) == docs.count()
    kept = {r.doc_id: r.kept for r in out}
    good = {r.doc_id for r in out if not r.base_failed} & set(range(40))
    assert sum(kept[i] for i in good) >= len(good) - 2 and not any(kept[i] for i in range(40, 55))
    assert not any(kept[i] for i in (90, 91, 92, 93))
    score = {r.doc_id: r.score for r in out}
    assert score[90] is None and score[91] is None and score[92] is not None
    names = sorted(tuple(r) for r in quality.keep(docs, labels).collect() if r.doc_id is not None)
    assert names == sorted(tuple(r) for r in docs.collect() if r.doc_id is not None and kept[r.doc_id])


def test_few_trusted_documents(corpus):
    docs, labels = corpus
    assert quality.trusted_keys(labels, 4).count() == 4
    assert quality.judge(docs, labels, limit=4).count() == docs.count()
    assert quality.judge(docs, labels.limit(0)).count() == docs.count()
    assert quality.judge(docs.limit(0), labels).collect() == []
    assert quality.keep(docs.limit(0), labels).collect() == []


def test_the_base_rule_alone_decides_where_nothing_was_learned(corpus):
    docs, labels = corpus
    passed = sorted(str(r.doc_id) for r in quality.judge(docs, labels).where("not base_failed").collect())
    for few in (labels.limit(0), labels.where("quality = 0")):
        assert sorted(str(r.doc_id) for r in quality.keep(docs, few).collect()) == passed
        assert sorted(str(r.doc_id) for r in quality.judge(docs, few).where("kept").collect()) == passed


def test_copies_of_a_text_change_no_score(spark):
    """A clean text without a label at a third of the rows is kept, and all texts have the scores that they have without its copies."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    before = {r.doc_id: (r.kept, r.score) for r in quality.judge(docs, labels).collect()}
    clean = next(r for r in docs.join(labels, "doc_id", "left_anti").orderBy("doc_id").collect() if before[r.doc_id][0])
    copies = spark.createDataFrame([(10**6 + i, *clean[1:]) for i in range(docs.count() // 2)], docs.schema)
    after = {r.doc_id: (r.kept, r.score) for r in quality.judge(docs.unionByName(copies), labels).collect()}
    assert all(after[10**6 + i] == before[clean.doc_id] for i in range(docs.count() // 2))
    assert {k: v for k, v in after.items() if k < 10**6} == before


def test_all_trusted_documents_count(spark):
    """More of them than a list of 20,000: each is counted or held out."""
    n = 21_000
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    docs = spark.range(n + 100).selectExpr("id AS doc_id", "concat('word', id) AS text")
    trusted = quality.trusted_keys(labels)
    assert trusted.count() == n
    fit = {r.doc_id for r in trusted.where("fit").collect()}
    good = np.zeros(quality.BUCKETS, np.int64)
    for i in fit:
        good[quality.buckets_of(quality.WordCodes().of([b"word%d" % i]))] += 1
    counts = quality.bucket_counts(docs, trusted).collect()
    assert sum(r.n_raw for r in counts) == n + 100
    assert {r.bucket: r.n_trusted for r in counts if r.n_trusted} == {i: k for i, k in enumerate(good.tolist()) if k}


def test_the_threshold_is_that_of_all_held_out_documents(spark):
    n = 50_000
    keys = spark.range(n).selectExpr("id AS doc_id", "id % 2 = 0 AS fit")
    scored = spark.range(n).selectExpr("id AS doc_id", "IF(id % 100 = 1, null, -cast(id AS double)) AS score")
    held = [-float(i) for i in range(n) if i % 2 and i % 100 != 1]
    assert abs(quality._threshold(scored, keys) - (np.quantile(held, quality.LOST) - quality.SLACK)) < 1e-7


def test_names_of_the_users_columns_do_not_clash(corpus):
    docs, labels = corpus
    odd = docs.withColumnRenamed("kept", "_kept").withColumnRenamed("score", "Kept")
    assert sorted(map(str, quality.keep(odd, labels).collect())) == sorted(
        str(r) for r in quality.keep(docs, labels).withColumnRenamed("kept", "_kept").withColumnRenamed("score", "Kept").collect())


def test_the_threshold_parts_good_from_bad_labels(spark):
    """Held-out accuracy: documents whose labels were not among the trusted."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    seen = {r.doc_id for r in quality.trusted_keys(labels, 1500).collect()}
    held = {r.doc_id: r.quality for r in labels.collect() if r.doc_id not in seen}
    out = [(held[r.doc_id], r.kept) for r in quality.judge(docs, labels, limit=1500).collect() if r.doc_id in held and not r.base_failed]
    assert sum(kept for good, kept in out if good) >= 0.985 * sum(good for good, _ in out)
    assert sum(not kept for good, kept in out if not good) >= 0.85 * sum(not good for good, _ in out)
