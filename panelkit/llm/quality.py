"""Quality rules (operator 3): a hashed n-gram likelihood ratio, and counts of plain defects.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over
the buckets, one of trusted documents and one of all documents, give each bucket
the logarithm of their ratio. A document's score is the mean of it over the
document's n-grams, so that length does not count. Each document is kept or not
by the same threshold; nothing is drawn at random.

The counts of the raw multinomial cover every document. The trusted documents
are all those with a good label. One half of them, by the last sign of a hash of
their key, makes the target multinomial. The other half sets the threshold: the
score that all but ``LOST`` of it reach, 0 at most. So trusted documents that were
not counted pass at any size of the corpus.

Both multinomials count each distinct text once, however many rows hold it, so that a
clean text is not lost to the number of its copies; a text is trusted if any of its
rows is.

Defined results: a NULL or empty text has no words, fails the base rule and
scores NULL; equal texts get equal results; without trusted documents the target
is flat. Where no trusted document that was held out has a score, the base rule
alone decides.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import in_batches, texts
from panelkit.operators.ranks import exact_quantiles
from panelkit.session import stage

BUCKETS = 1 << 16
#: Trusted documents up to which the SQL of ``op3_quality_rules`` holds. The operator counts all.
MAX_TRUSTED = 20_000
#: Share of the trusted documents held out that may fall below the threshold.
LOST = 0.002
#: Taken off the threshold, so that it does not hang on the last bits of a sum.
SLACK = 1e-6
MIN_WORDS = 50
WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Word codes that a task keeps at once.
KEPT = 200_000


class WordCodes:
    """32 bits of the MD5 digest of each word, remembered for the words seen lately."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > KEPT:
                self.known.clear()
            for i, word in enumerate(words):
                if found[i] is None:
                    found[i] = self.known[word] = int.from_bytes(md5(word).digest()[:4], "big")
        return np.array(found, dtype=np.int64)


def buckets_of(codes: np.ndarray) -> np.ndarray:
    """The buckets of all words and word pairs of a document."""
    return np.concatenate([codes, codes[:-1] * 31 + codes[1:]]) & (BUCKETS - 1)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()  # bytes split at ASCII white space only


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]  # below n, so no overflow
    _, at, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(times[at] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 3, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:n]))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    blanks = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def trusted_keys(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Keys of well labelled documents, and whether each is counted (``fit``) or held out.

    All of them, or with a limit the first by a hash.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    digest = F.md5(F.col("doc_id").cast("string"))
    first = good if limit is None else good.orderBy(digest, "doc_id").limit(limit)
    return first.withColumn("fit", F.conv(F.substring(digest, 32, 1), 16, 10).cast("int") % 2 == 0)


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Per bucket its n-grams in all distinct texts (``n_raw``) and in trusted ones (``n_trusted``).

    Each task counts into two arrays of fixed size, so what it sends on does not
    grow with its input. Texts are shuffled to count each distinct one once: copies
    meet in the map tasks first, so that a group of them sends one row a task. The
    trusted keys, any number of them, are joined to digests of the texts, not to texts.
    """
    own = texts(docs).select("doc_id", "text", F.sha2("text", 256).alias("digest"), F.length("text").alias("size"))
    good = own.select("doc_id", "digest", "size").join(trusted.where("fit").select("doc_id"), "doc_id")
    both = own.select("digest", "size", "text", F.lit(False).alias("good")).unionByName(
        good.select("digest", "size", F.lit(None).cast("string").alias("text"), F.lit(True).alias("good")))
    flagged = both.groupBy("digest", "size").agg(F.first("text", ignorenulls=True).alias("text"), F.bool_or("good").alias("good"))

    def count(batches):
        codes, raw, good = WordCodes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column("text"), batch.column("good")):
                found = np.bincount(buckets_of(codes.of(words_of(text.as_py()))), minlength=BUCKETS)
                raw += found
                if is_good.as_py():
                    good += found
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "n_raw", "n_trusted"]
        )

    parts = flagged.select("text", "good").mapInArrow(count, "bucket int, n_raw long, n_trusted long")
    return parts.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_trusted").alias("n_trusted"))


def bucket_weights(counts: DataFrame) -> np.ndarray:
    """Log ratio per bucket, with one n-gram added to each count; ``BUCKETS`` numbers."""
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, n_raw, n_trusted in counts.collect():  # at most BUCKETS rows
        raw[bucket] += n_raw
        good[bucket] += n_trusted
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _weights(docs: DataFrame, trusted: DataFrame, key: str, text: str):
    """The weights, half a megabyte that each task reads."""
    return docs.sparkSession.sparkContext.broadcast(bucket_weights(bucket_counts(texts(docs, key, text), trusted)))


def _threshold(scored: DataFrame, trusted: DataFrame) -> float:
    """The score that all but ``LOST`` of the held-out rows reach; below all scores where none of them has one."""
    held = scored.where("score is not null").join(trusted.where("not fit").select("doc_id"), "doc_id")
    least = exact_quantiles(held, [], "score", {"least": LOST}).first()[0]
    return float(-np.inf if least is None else min(0.0, least) - SLACK)


def _scores(found: list[str], codes: WordCodes, weights: np.ndarray) -> list[float | None]:
    buckets = (buckets_of(codes.of(w)) if w else None for w in map(words_of, found))
    return [None if b is None else float(weights[b].mean()) for b in buckets]


def _counts(found: list[str]) -> np.ndarray:
    return np.array([base_counts(t, words_of(t)) for t in found], dtype=np.int64).reshape(-1, len(NAMES))


def failed(n_words, n_repeat_words):
    """The base rule, on columns or numbers."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def judge(
    docs: DataFrame, labels: DataFrame, limit: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document its counts, its score and whether it is kept.

    Passes over the documents: one to find trusted texts, one to count, which shuffles
    distinct texts, and one to score. Scores are written, for the threshold and the result.
    """
    trusted, kind = stage(trusted_keys(labels, limit), "trusted"), dict(docs.dtypes)[key]
    weights = _weights(docs, trusted, key, text)

    def judged(columns: dict, codes: WordCodes) -> dict:
        found = columns["text"].to_pylist()
        numbers, scores = _counts(found), _scores(found, codes, weights.value)
        return {"doc_id": columns["doc_id"], "score": scores, **{c: pa.array(numbers[:, i]) for i, c in enumerate(NAMES)}}

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in NAMES)}, score double"
    scored = stage(in_batches(texts(docs, key, text), schema, judged, WordCodes), "scored")
    base = failed(F.col("n_words"), F.col("n_repeat_words"))
    return scored.select(
        "doc_id", *NAMES, base.alias("base_failed"),
        (~base & F.coalesce(F.col("score") >= F.lit(_threshold(scored, trusted)), F.lit(False))).alias("kept"), "score",
    )


def keep(docs: DataFrame, labels: DataFrame, limit: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, in the same passes; rows are written with their scores."""
    trusted, names = stage(trusted_keys(labels, limit), "trusted"), docs.columns
    weights, own = _weights(docs, trusted, key, text), [f"c{i}" for i in range(len(names))]
    body = own[names.index(text)]

    def judged(columns: dict, codes: WordCodes) -> dict:
        found = [t or "" for t in columns[body].to_pylist()]
        numbers, scores = _counts(found), _scores(found, codes, weights.value)
        return {**columns, "score": scores, "failed": pa.array(failed(numbers[:, 0], numbers[:, 4]))}

    # Numbered columns, so that no name of the user's is one of those added.
    rows = docs.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, own)], F.col(key).alias("doc_id"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", score double, failed boolean"
    scored = stage(in_batches(rows, schema, judged, WordCodes), "scored")
    passed = ~F.col("failed") & (F.col("score") >= F.lit(_threshold(scored.select("doc_id", "score"), trusted)))
    return scored.where(passed).select(*[F.col(c).alias(n) for n, c in zip(names, own)])
