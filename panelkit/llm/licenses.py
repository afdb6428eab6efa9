"""License scans (operator 4): MinHash bands over text windows, then exact containment.

Words are runs of letters and digits in lower case. A text is cut into windows of
six words, each overlapping the next by four, and a window has up to two shingles
of five words. The windows of a template start at each word, and each of its
shingles is a window too. A band is one MinHash value. A text window that holds a
shingle of a template is at least half like the window of that shingle alone, so
one band finds it with probability 1/2 or more, and ``BANDS`` bands miss it with
probability 2^-16 at most.

What the bands retrieve is verified by the shingles themselves: a template is found
in a document if the retrieved windows hold at least ``CONTAINED`` of its shingles.

Templates are a parameter, full license texts as well as notices: their number and
their words, and so the size of the band table that is sent to all tasks, are known
and bounded before anything is read. A template without a shingle is an error.

Defined results: NULL, empty and short texts hold no template; each row is a document
of its own, whatever its key, so repeated rows and keys give repeated results; no rows
give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 16
CONTAINED = 0.8
#: Bounds of the templates, in number and in words of all of them; a word gives some 300 bytes to send.
MAX_TEMPLATES, MAX_WORDS = 2000, 100_000
WORD_BREAK = r"[^\p{L}\p{N}]+"

# Statements by which common licenses are named or opened.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """64-bit hashes of the five-word shingles, in their order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= SHINGLE,
        F.transform(F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(SHINGLE)])),
    ).otherwise(F.array().cast("array<bigint>")))


def windows(hashes: Column, step: int) -> Column:
    """Windows as (at, a, b): the place of the first shingle and the one or two hashes."""
    return F.when(F.size(hashes) > 0, F.transform(
        F.sequence(F.lit(1), F.size(hashes), F.lit(step)),
        lambda i: F.struct((i - 1).alias("at"), F.element_at(hashes, i).alias("a"), F.try_element_at(hashes, i + 1).alias("b")),
    ))


def bands(a: Column, b: Column) -> Column:
    """One MinHash value per band: the least hash after flipping the band's fixed bits."""
    flips = [((0x9E3779B97F4A7C15 * (k + 1) ^ 0xD1B54A32D192ED03 * (k + 7)) & (1 << 64) - 1) for k in range(BANDS)]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    flipped = lambda h, f: h.bitwiseXOR(F.lit(f))
    return F.array(*[F.least(flipped(a, f), F.coalesce(flipped(b, f), flipped(a, f))) for f in signed])


def template_rows(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``license`` and the hashes of its template."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates, so that their table may be sent to all tasks")
    sizes = {n: len([w for w in re.split(r"[\W_]+", t) if w]) for n, t in templates.items()}
    if sum(sizes.values()) > MAX_WORDS:
        raise ValueError(f"at most {MAX_WORDS} words in all templates, so that their table may be sent to all tasks")
    if short := sorted(n for n, size in sizes.items() if size < SHINGLE):
        raise ValueError(f"templates {short} have fewer than {SHINGLE} words and would never be found")
    listed = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in sorted(templates.items())])
    return spark.range(1).select(F.inline(listed)).select("license", shingles(F.col("text")).alias("hashes"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Templates found: ``doc_id``, ``license``, its shingles found and in all, their share, and the first word.

    Only rows for documents that hold a template. Texts are not shuffled; what the
    bands retrieve is.
    """
    known = template_rows(docs.sparkSession, templates)
    single = F.transform("hashes", lambda h: F.struct(F.lit(0).alias("at"), h.alias("a"), F.lit(None).cast("bigint").alias("b")))
    sought = known.select("license", F.inline(F.concat(windows(F.col("hashes"), 1), single))).select(
        "license", F.posexplode(bands(F.col("a"), F.col("b"))).alias("band", "value")
    ).distinct()
    # Where a row stands tells rows apart that share a key.
    rows = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    cut = rows.select("doc_id", "row", F.inline(_let(shingles(F.col("text")), lambda h: windows(h, 2))))
    banded = cut.select("doc_id", "row", "at", "a", "b", F.posexplode(bands(F.col("a"), F.col("b"))).alias("band", "value"))
    retrieved = banded.join(F.broadcast(sought), ["band", "value"]).select("doc_id", "row", "license", "at", "a", "b").distinct()
    own = retrieved.select("doc_id", "row", "license", F.inline(F.array(
        F.struct(F.col("at").alias("word"), F.col("a").alias("h")), F.struct((F.col("at") + 1).alias("word"), F.col("b").alias("h")))))
    exact = known.select("license", F.explode(F.array_distinct("hashes")).alias("h"), F.size(F.array_distinct("hashes")).cast("long").alias("n_shingles"))
    held = own.join(F.broadcast(exact), ["license", "h"]).groupBy("doc_id", "row", "license", "n_shingles", "h").agg(F.min("word").alias("word"))
    counted = held.groupBy("doc_id", "row", "license", "n_shingles").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("word").cast("long").alias("first_word"))
    share = F.col("n_found") / F.col("n_shingles")
    return counted.withColumn("containment", share).where(F.col("containment") >= CONTAINED).select(
        "doc_id", "license", "n_found", "n_shingles", "containment", "first_word")
