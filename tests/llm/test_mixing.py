"""Replication counts and target shares."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from panelkit.llm import mixing


def plain_count(rate, seed, key, text):
    own = hashlib.md5((text or "").encode()).hexdigest()
    parts = max(1, math.ceil(rate / mixing.PART))
    total = 0
    for i in range(1, parts + 1):
        digest = hashlib.md5(f"{seed}|{key}|{own}|{i}".encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 2**52
        r, k = rate / parts, 0
        p = below = math.exp(-r)
        while u >= below and k < 200:
            k += 1
            p *= r / k
            below += p
        total += k
    return total


def docs_of(spark, n, copies=1):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
        F.when(F.col("id") % 10 < 6, "big").when(F.col("id") % 10 < 9, "small").alias("source"), F.lit(1).alias("copy"), F.lit("x").alias("rate"),
    )


@pytest.mark.parametrize("weights", [None, {"big": 1.0, "small": 1.0}, {"small": 1.0}, {"(none)": 3.0, "big": 0.0}])
def test_counts_follow_the_distribution(spark, weights):
    docs = docs_of(spark, 900)
    n = {"big": 540, "small": 270, "(none)": 90}
    w = {s: (c ** 0.5 if weights is None else weights.get(s, 0.0)) for s, c in n.items()}
    out = {}
    rows = mixing.mix(docs, weights).collect()
    for r in rows:
        out.setdefault(r.doc_id, []).append(r.copy)
    for r in docs.collect():
        s = r.source or "(none)"
        rate = w[s] * 900 / sum(w.values()) / n[s]
        assert sorted(out.get(r.doc_id, [])) == list(range(1, plain_count(rate, mixing.SEED, r.doc_id, r.text) + 1))
    assert len(rows) == pytest.approx(900, rel=0.12)


def test_large_rates_are_drawn_in_parts(spark):
    docs = docs_of(spark, 2000).where("doc_id % 100 = 9 or source = 'big'")
    rows = mixing.mix(docs, {"(none)": 1.0}).collect()
    rate = rows[0].rate
    assert rate > 3 * mixing.PART and {r.source for r in rows} == {None}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert all(got.get(k, 0) == plain_count(rate, mixing.SEED, k, f"text {k}") for k in got)
    assert len(rows) == pytest.approx(docs.count(), rel=0.1)


def test_rows_of_every_kind(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (None, None, None), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"shuffle_key": F.lit(0), "copy": F.lit(0)})
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "rate", "copy", "shuffle_key"]
    per = {}
    for r in out.collect():
        per[r.doc_id] = per.get(r.doc_id, 0) + 1
    assert per.get(1, 0) % 2 == 0  # equal rows get equal counts
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs, {"other": 1.0}).collect() == []


def test_the_order_is_random_and_repeatable(spark):
    docs = docs_of(spark, 400)
    first = [r.doc_id for r in mixing.mix(docs).collect()]
    assert first == [r.doc_id for r in mixing.mix(docs).collect()]
    assert first != sorted(first) and [r.doc_id for r in mixing.mix(docs, seed=8).collect()] != first


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_rows_without_a_key_are_drawn_one_by_one(spark, seed):
    """Copies without a key, at 1,000 of 1,300 rows: about as many stay as the rate says, in several partitions."""
    rows = spark.range(1300).selectExpr("CASE WHEN id >= 1000 THEN id END AS doc_id", "CASE WHEN id < 600 THEN 'same' ELSE concat('t', id) END AS text",
                                        "CASE WHEN id < 1000 THEN 'big' ELSE 'small' END AS source").repartition(5, "source", "text")
    docs = rows.select("*")
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0}, seed=seed)
    found = out.where("doc_id IS NULL").groupBy("text").count().collect()
    assert sum(r["count"] for r in found) == pytest.approx(650, abs=130)
    assert {r.text: r["count"] for r in found}["same"] == pytest.approx(390, abs=100)
    sizes = [r["count"] for r in out.where("text = 'same'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 1 or max(sizes) < 0.8 * sum(sizes)
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(docs, {"big": 1.0, "small": 1.0}, seed=seed).collect()))


def test_names_of_the_users_columns_do_not_clash(spark):
    docs = docs_of(spark, 50).drop("copy", "rate").withColumns({c: F.lit(1) for c in ("_copies", "copies", "_mixed_source", "mixed_source", "row", "text_md5")})
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "rate", "copy", "shuffle_key"]
    assert sorted(map(str, out.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
