"""The pipeline's rows against a plain version of its stages, and each stage on odd rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import check, oracle
from panelkit.llm import mixing, pieces, pii
from panelkit.llm.queries import ORACLES, PIECE_MODEL, QUERIES
from test_mixing import plain_count
from test_simhash import plain_components, plain_fingerprint

D = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "encode"]


def test_run_equals_a_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    kept = sorted(r[0] for r in oracle(D).execute(f"SELECT doc_id, kept FROM ({ORACLES['op3_quality_rules']})").fetchall() if r[1])
    component = plain_components([plain_fingerprint(docs[k].text) for k in kept])
    kept = [k for i, k in enumerate(kept) if component[i] == i]
    text = {k: pii.redacted(docs[k].text) for k in kept}
    sizes = {}
    for k in kept:
        source = docs[k].source or mixing.NO_SOURCE
        sizes[source] = sizes.get(source, 0) + 1
    weight = {s: n ** mixing.FLATTENING for s, n in sizes.items()}
    sp, expected = pieces.loaded(PIECE_MODEL).processor, []
    for k in kept:
        source = docs[k].source or mixing.NO_SOURCE
        n = plain_count(weight[source] * len(kept) / math.fsum(weight.values()) / sizes[source], mixing.SEED, k, text[k])
        ids = sp.encode(text[k])
        expected += [(k, len(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids)] * n
    out = corpus_pipeline.run(spark, D).select("doc_id", "n_tokens", "decoded_sha256", "ids").collect()
    assert sorted(map(tuple, out)) == sorted(expected) and len(expected) > 0.3 * len(docs)


@pytest.mark.parametrize("rows", [[], [
    (1, "word " * 9, "en", "s", 45), (None, None, None, None, None), (2, "", "en", None, 0), (3, "a@b.de " * 60, "en", "s", 9),
    (3, "a@b.de " * 60, "en", "s", 9), (4, "other text of some length " * 30, "en", "t", 1), (None, "x y z", "en", "t", 5),
]])
def test_stages_on_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, D)
        assert out.columns == COLUMNS and out.dtypes == df.dtypes, name
        assert out.count() <= 10 * max(1, len(rows))
    assert corpus_pipeline.near_dedup(spark, df, D).where("doc_id is null").count() == sum(r[0] is None for r in rows)
    assert corpus_pipeline.encode(spark, df, D).count() == len(rows)


def test_one_document_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame(
        [(i, base + (f" x{i}" if i % 2 else ""), "en", "s", 1) for i in range(20, 40)] + [(7, "something else entirely here", "en", "s", 1)], ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long"]))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, D).collect()) == [7, 20]


def test_rows_are_told_apart_by_key_and_text(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(-5, first), (3, second), (3, first), (3, second), (None, third), (None, third), (None, second), (None, None), (20, third)]
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, D).collect()]
    assert sorted(out, key=str) == sorted([(-5, first), (3, second), (20, third), (None, None)], key=str)
    unknown = corpus_pipeline.near_dedup(spark, df.where("doc_id is null"), D).collect()
    assert sorted(str(r.text) for r in unknown) == sorted([third, second, "None"])


def test_copies_of_a_clean_text_do_not_reject_it(spark):
    """An unlabelled text at a third of the rows; one copy is left for the stages that follow."""
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.quality_rules(spark, docs, D)
    clean = kept.join(labels, "doc_id", "left_anti").orderBy("doc_id").first()
    copies = spark.createDataFrame([(10**6 + i, *clean[1:]) for i in range(docs.count() // 2)], docs.schema)
    out = corpus_pipeline.quality_rules(spark, docs.unionByName(copies), D)
    assert out.where(F.col("text") == clean.text).count() >= copies.count() + 1
    assert corpus_pipeline.near_dedup(spark, out, D).where(F.col("text") == clean.text).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    status = check(oracle(D), QUERIES[name](spark, D), ORACLES[name])
    assert status.startswith("ok"), status


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_native_operators_have_no_python_in_their_plans(spark):
    for name in ("op4_license_scan", "op7_source_mixing", "op9_preference_format", "op10_document_fingerprints"):
        plan = QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD", "Cartesian", "NestedLoop")), name


def test_a_column_named_row_stays(spark):
    df = spark.createDataFrame([(1, "some words of a text", "a", "b"), (2, "some words of a text", "c", "d")], "doc_id long, text string, _row string, row string")
    out = corpus_pipeline.near_dedup(spark, df, D)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "some words of a text", "a", "b")]
