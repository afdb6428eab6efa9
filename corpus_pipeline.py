"""From raw documents to encoded training text, stage by stage.

Each stage reads what its predecessor has written and hands on all that it keeps.
``ORACLE_SQL`` is None: SQL engines have neither the fingerprints' hash (stage 2)
nor the encoder (stage 5). Tests hold ``run`` against a plain version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import mixing, pieces, pii, quality, simhash
from panelkit.llm.common import own_name, table
from panelkit.llm.queries import PIECE_MODEL
from panelkit.session import shared_path, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the smallest key, then text hash; unknown keys come last.

    Rows are told apart by key and text, so unlike texts under one key both stay.
    A row with neither is a copy of nothing and stays.
    """
    name = own_name("row", docs)
    blank = F.col("doc_id").isNull() & F.col("text").isNull()
    row = F.concat_ws("|", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("doc_id").cast("string"))
    keyed = docs.where(~blank).withColumn(name, row)
    found = stage(simhash.near_duplicates(keyed, key=name), "near-duplicates")
    own = F.when(F.length("doc_id") > 64, F.substring("doc_id", 66, 1 << 30)).cast(dict(docs.dtypes)["doc_id"])
    first = F.min(F.struct(own.isNull().alias("unknown"), own.alias("key"), F.col("doc_id").alias("row")))
    chosen = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(name))
    kept = keyed.dropDuplicates([name]).join(chosen, name, "left_semi")
    return kept.select(*docs.columns).unionByName(docs.where(blank))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, and digests of them and of the text that they decode to."""
    return pieces.digests(pieces.encode_decode(docs, PIECE_MODEL), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules), ("near_dedup", near_dedup), ("pii", redact_pii), ("mixing", mix_sources), ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
