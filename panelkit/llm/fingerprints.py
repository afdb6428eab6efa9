"""Document fingerprints (operator 10): one-permutation MinHash with packed low bits.

The hashes of a text's five-word shingles are computed once. The upper bits of a
hash choose one of ``BINS`` bins, and each bin keeps the least of the rest. An
empty bin borrows from a full one that hashing picks for it alone, independent of
the text (optimal densification): up to ``TRIES`` hashed bins in turn, then the full
bin of least hashed priority. Of each bin's value the low ``BITS`` bits are stored,
in hex. Chance agreement of those bits is taken out of the likeness.

Everything is DataFrame operations; a text's hashes are sorted in its row, so bins
need neither a shuffle nor a group.

Defined results: a NULL or empty text has the fingerprint of no shingles, all
zero, which is wholly like itself and unlike any other; a text of fewer than five
words has one shingle of all its words; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import words_of
from panelkit.session import stage

SHINGLE = 5
BINS = 128
BITS = 8
TRIES = 6
_BIN_BITS = BINS.bit_length() - 1
_NONE = -1


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the shingles, each from the hashes of its words."""
    words = F.transform(words_of(text), lambda w: F.xxhash64(w))
    one = F.array(F.xxhash64(F.concat_ws(",", words.cast("array<string>"))))

    def from_words(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(
            F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(size)])
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, one).otherwise(runs)

    return let(words, from_words)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - _BIN_BITS).cast("int")


def bins(hashes: Column) -> Column:
    """The least hash of each full bin, at the bin's place; NULL in empty ones.

    Sorted, the hashes of a bin stand together, the least first.
    """
    def least(ordered: Column) -> Column:
        firsts = F.filter(
            ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.element_at(ordered, F.greatest(i, F.lit(1)))))
        )
        return let(
            F.map_from_entries(F.transform(firsts, lambda h: F.struct(bin_of(h), h))),
            lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(m, b)),
        )

    return let(F.array_sort(hashes), least)


def densified(values: Column) -> Column:
    """Empty bins take the value of a full bin that only their number decides."""
    def fill(v: Column) -> Column:
        full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.element_at(v, b + 1).isNotNull())

        def borrowed(b: Column, full: Column) -> Column:
            tries = [F.element_at(v, (F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)) + 1).cast("int")) for t in range(TRIES)]
            nearest = F.array_min(F.transform(full, lambda f: F.struct(F.xxhash64(b, f).alias("rank"), f.alias("bin"))))["bin"]
            return F.coalesce(F.element_at(v, b + 1), *tries, F.element_at(v, nearest + 1))

        return let(full, lambda f: F.when(F.size(f) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: borrowed(b, f))))

    return let(values, fill)


def codes(text: Column) -> Column:
    """The stored low bits of each bin, less 2^BITS / 2 to fit a byte; an empty array without shingles."""
    return F.transform(
        densified(bins(shingle_hashes(text))), lambda h: (h.bitwiseAND((1 << BITS) - 1) - (1 << BITS - 1)).cast("tinyint")
    )


def packed(code: Column) -> Column:
    """The codes in hex; zeros where there are none."""
    digits = F.transform(code, lambda c: F.lower(F.lpad(F.hex(c.cast("int") + (1 << BITS - 1)), BITS // 4, "0")))
    return F.when(F.size(code) == 0, F.lit("0" * (BINS * BITS // 4))).otherwise(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two code arrays, in 0 to 1.

    Unlike bins agree by chance with 1 in 2^BITS; that share is taken out.
    """
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e)
    chance = 1.0 / (1 << BITS)
    estimate = F.greatest((equal / float(BINS) - chance) / (1.0 - chance), F.lit(0.0))
    none = F.size(a) + F.size(b) == 0
    return F.when(none, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(estimate)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and ``fingerprint``. No shuffle."""
    return docs.select(F.col(key).alias("doc_id"), packed(codes(F.coalesce(F.col(text), F.lit("")))).alias("fingerprint"))


def followers(rows: DataFrame) -> DataFrame:
    """Places of rows in descending order of ``doc_id``, and the place that follows each.

    A sort by range numbers the rows of each partition; the last row of one is
    followed by the first of the next partition that has rows, and the last row of
    all by the first. Only keys and lengths are sorted, and the table that ties
    partitions together has a row for each of them.
    """
    ordered = rows.orderBy(F.desc_nulls_last("doc_id"), "n_chars", "row", "twin").withColumn("place", F.monotonically_increasing_id())
    ordered = stage(ordered, "ordered")
    edges = ordered.groupBy(F.shiftright("place", 33)).agg(F.struct(F.min("place").alias("first"), F.max("place").alias("last")).alias("e"))
    edges = edges.agg(F.array_sort(F.collect_list("e")).alias("edges"))  # an entry for each partition of the sort
    ties = edges.select(F.posexplode("edges").alias("i", "e"), "edges").select(
        F.col("e.last").alias("place"), F.element_at("edges", F.pmod(F.col("i") + 1, F.size("edges")) + 1)["first"].alias("next"),
    )
    return stage(ordered.join(stage(ties, "ties"), "place", "left").withColumn("next", F.coalesce("next", F.col("place") + 1)), "followers")


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against an edited copy of itself and against the next text.

    The edited text has the last half of the code points replaced by as many of the
    next text's first (or all of it). Repeated rows (equal key and text) count as one
    in the order, so they share the row that follows.

    Of the texts, each moves once, to meet its place in the order, and then the part
    that its predecessor needs moves once more. Rows are known by 128 bits of hashes
    of key and text, unique but for repeated rows, which adaptive execution splits.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("doc_id"), body.alias("text")).withColumns(
        {"row": F.xxhash64("doc_id", "text"), "twin": F.xxhash64(F.lit(1), "text", F.lit(2), "doc_id")})
    sized = own.select("doc_id", "row", "twin", F.char_length("text").cast("long").alias("n_chars")).distinct()
    places = followers(sized)
    before = places.select(
        F.col("next").alias("place"), F.col("row").alias("before_row"), F.col("twin").alias("before_twin"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("take"))
    spots = stage(places.join(before, "place").select("doc_id", "row", "twin", "before_row", "before_twin", "take", "n_chars"), "spots")
    # Both joins are on the same two hashes, so the texts stay where the first one has put them. Keys come
    # from the table of places: then both branches need the same columns of the texts, and share their shuffle.
    placed = own.drop("doc_id").withColumn("code", codes(F.col("text"))).join(spots, ["row", "twin"])
    lent = placed.select(
        F.col("before_row").alias("row"), F.col("before_twin").alias("twin"),
        F.struct(F.substring("text", F.lit(1), F.col("take")).alias("tail"), F.col("code").alias("next_code")).alias("lent"),
    ).groupBy("row", "twin").agg(F.any_value("lent").alias("lent"))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("lent.tail"))
    return placed.join(lent, ["row", "twin"]).select("doc_id", "n_chars", "code", F.col("lent.next_code").alias("next_code"), edited.alias("edited")).withColumn(
        "edited_code", codes(F.col("edited"))
    ).select(
        "doc_id", "n_chars", "edited", packed(F.col("code")).alias("fingerprint"), packed(F.col("edited_code")).alias("edited_fingerprint"),
        likeness(F.col("code"), F.col("edited_code")).alias("near_edited"), likeness(F.col("code"), F.col("next_code")).alias("near_next"),
    )
