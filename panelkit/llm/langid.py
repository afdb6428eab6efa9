"""Language ID (operator 2) by fusing evidence with Bayes' rule.

For each page the posterior of a language is in proportion to four factors:

* the likelihood of its visible text, from hashed three-byte sequences counted over
  all labelled documents; the mean per sequence counts as ``EVIDENCE`` of them at
  most, since neighbouring sequences are not independent;
* the likelihood of the language that the markup declares, given the true one;
* the likelihood of the address suffix (the last part of the host), given the language;
* a prior of the host, smoothed towards that of its domain, and that towards the
  share over all pages. A page's own text is taken out of the counts of its host,
  domain and suffix, so that it does not speak twice.

The last three are learned from the pages' text posteriors, summed by group. A
page that declares nothing, has no host or no text lacks that factor; a page that has
none of them gets the language that is most frequent over all pages, and a page alone
on its suffix lacks that factor too. Ties go to the language that comes first by name.

Languages are those that documents are labelled with, ``MAX_LANGUAGES`` at most; more
are an error. Without any, all pages are in the language ``und``.
"""

from __future__ import annotations

import html as markup
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import in_batches
from panelkit.session import stage

MAX_LANGUAGES = 64
BUCKETS = 1 << 14
EVIDENCE = 40.0
#: Weight of the broader level against the counts of a host, domain, suffix or declaration.
SMOOTHING = 5.0
#: What is assumed of declarations before any is seen: so many of them are right.
HONEST = 0.9

_HIDDEN = re.compile(r"<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def visible(html: str) -> str:
    return markup.unescape(_HIDDEN.sub(" ", html))


def buckets_of(text: str) -> np.ndarray:
    """Buckets of all three-byte sequences of a text in lower case."""
    raw = np.frombuffer(b" ".join(text.lower().encode().split()), np.uint8).astype(np.uint32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (three * np.uint32(2654435761)) >> np.uint32(18)


def languages_of(docs: DataFrame, lang: str = "lang", most: int = MAX_LANGUAGES) -> tuple[str, ...]:
    """The languages of labelled documents in the order of their names."""
    known = docs.where(F.col(lang).isNotNull() & (F.col(lang) != "")).select(lang).distinct().limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"documents in more than {most} languages; give the languages to tell apart")
    return tuple(sorted(r[0] for r in known)) or ("und",)


def sequence_counts(docs: DataFrame, languages: tuple[str, ...], text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all documents in a known language.

    Each task counts into one array per language, so it sends on a bounded number of rows.
    """
    def count(batches):
        seen = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for t, name in zip(batch.column("text"), batch.column("lang")):
                seen[languages.index(name.as_py())] += np.bincount(buckets_of(t.as_py()), minlength=BUCKETS)
        which, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[which, bucket])], names=["lang", "bucket", "n"])

    known = docs.where(F.col(lang).isin(*languages) & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    return known.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def log_model(counts: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log probability of each bucket in each language; languages x ``BUCKETS`` numbers."""
    model = np.ones((len(languages), BUCKETS))
    for lang, bucket, n in counts.collect():  # at most as many rows
        model[lang, bucket] += n
    return np.log(model / model.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, model: np.ndarray, key: str = "page_id", html: str = "html") -> DataFrame:
    """Key, address parts, declared language and the text's log likelihoods of each page."""
    spread = pages.sparkSession.sparkContext.broadcast(model)
    kind = dict(pages.dtypes)[key]

    def weigh(columns: dict) -> dict:
        out = []
        for page in columns["text"].to_pylist():
            found = buckets_of(visible(page))
            if len(found):
                ll = spread.value[:, found].mean(axis=1) * min(len(found), EVIDENCE)
                out.append((ll - ll.max()).tolist())
            else:
                out.append([0.0] * len(spread.value))
        return {**{c: columns[c] for c in ("doc_id", "host", "declared")}, "ll": out}

    host = F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), DECLARED, 1)), F.lit(""))
    own = pages.select(F.col(key).alias("doc_id"), F.col("url").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).select(
        "doc_id", F.col("html").alias("text"), host.alias("host"), declared.alias("declared"))
    return in_batches(own, f"doc_id {kind}, host string, declared string, ll array<double>", weigh)


def softmax(logs: list[Column]) -> list[Column]:
    top = F.array_max(F.array(*logs))
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def identify(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...] | None = None, key: str = "page_id") -> DataFrame:
    """Per page: key, ``host``, ``declared``, ``text_lang`` (by text alone), ``lang`` and its ``probability``.

    Groups are summed in the map tasks first; the table of hosts is written, so that
    a host with very many pages is split when pages meet it.
    """
    languages = languages_of(docs) if languages is None else languages
    n_lang = range(len(languages))
    model = log_model(stage(sequence_counts(docs, languages), "sequences"), languages)
    pages_ = text_evidence(pages, model, key)
    p = softmax([F.col("ll")[i] for i in n_lang])
    parts = F.split("host", r"\.")
    weighed = stage(pages_.select(
        "doc_id", "host", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"),
        F.element_at(parts, -1).alias("suffix"),
        F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNotNull(), "other").alias("declared"),
        "ll", *[x.alias(f"p{i}") for i, x in zip(n_lang, p)],
    ), "weighed")
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in n_lang]

    hosts = stage(weighed.where("host is not null").groupBy("host", "domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("n")), "hosts")
    up = lambda by, name: hosts.groupBy(by).agg(
        *[F.sum(f"p{i}").alias(f"{name}{i}") for i in n_lang], F.sum("n").alias(f"{name}_n"))
    table = stage(hosts.drop("suffix").withColumnsRenamed({**{f"p{i}": f"h{i}" for i in n_lang}, "n": "h_n"}).join(
        stage(up("domain", "d"), "domains"), "domain").drop("domain"), "host-table")
    suffixes = stage(up("suffix", "s"), "suffixes")

    # One row, and one per declared language: bounded by the list of languages.
    whole = weighed.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    share = [((whole[f"p{i}"] or 0.0) + 1.0) / (whole["n"] + len(languages)) for i in n_lang]
    stated = {r["declared"]: r for r in weighed.where("declared is not null").groupBy("declared").agg(*sums).collect()}
    given = [sum(r[f"p{i}"] for r in stated.values()) for i in n_lang]
    with_suffix = suffixes.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in n_lang], F.sum("s_n").alias("n")).first()

    def declared_log(i: int) -> Column:
        """Log of P(declared | language i), from 0 on where nothing is declared."""
        out = F.lit(0.0)
        for name, r in stated.items():
            assumed = HONEST if name == languages[i] else (1 - HONEST) / len(languages)
            out = F.when(F.col("declared") == name, math.log((r[f"p{i}"] + SMOOTHING * assumed) / (given[i] + SMOOTHING))).otherwise(out)
        return out

    def suffix_log(i: int) -> Column:
        """Log of P(suffix | language i) over the other pages, smoothed towards the suffix's own share; NULL without any."""
        if (with_suffix["n"] or 0) < 2:
            return F.lit(None).cast("double")
        own = (F.col("s_n") - 1) / (with_suffix["n"] - 1)
        rest = F.greatest(F.lit(with_suffix[f"s{i}"]) - F.col(f"p{i}"), F.lit(0.0))
        return F.when(F.col("s_n") > 1, F.log((less(f"s{i}", i) + SMOOTHING * own) / (rest + SMOOTHING)))

    def less(c: str, i: int) -> Column:
        return F.greatest(F.col(c) - F.col(f"p{i}"), F.lit(0.0))

    def host_log(i: int) -> Column:
        domain = (less(f"d{i}", i) + SMOOTHING * share[i]) / (F.col("d_n") - 1 + SMOOTHING)
        return F.log((less(f"h{i}", i) + SMOOTHING * domain) / (F.col("h_n") - 1 + SMOOTHING))

    logs = [
        F.col("ll")[i] + declared_log(i) + F.coalesce(suffix_log(i), F.lit(0.0)) + F.coalesce(host_log(i), F.lit(math.log(share[i])))
        for i in n_lang
    ]
    fused = weighed.join(table, "host", "left").join(suffixes, "suffix", "left")
    best = lambda values: F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(F.array(*values), F.array_max(F.array(*values))).cast("int"))
    posterior = fused.withColumn("posterior", F.array(*softmax(logs)))
    after = [F.col("posterior")[i] for i in n_lang]
    return posterior.select(
        F.col("doc_id").alias(key), "host", "declared", best([F.col(f"p{i}") for i in n_lang]).alias("text_lang"),
        best(after).alias("lang"), F.array_max(F.array(*after)).alias("probability"),
    )
