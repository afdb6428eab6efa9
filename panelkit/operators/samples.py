"""Samples without replacement of exact sizes, per group.

Rows are ordered by a hash of their key, and the first k of a group are its sample,
so a sample is the same in every run and on every cluster. No task sorts a group:
hashes are counted by their leading bits, and running totals (:mod:`ranks`) tell which
of these slices holds the k-th smallest hash of a group. The hashes of that slice alone
are then reduced to frequencies, whose running totals give the hash itself as the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.keys import null_safe_join
from panelkit.operators.ranks import running_totals
from panelkit.session import stage

SEED = 2019
#: Hex digits of the digest that make up a hash.
DIGITS = 15
#: Leading bits of a hash by which it is counted first.
SLICE_BITS = 12
#: Copies of a row that one task gives back at once.
COPIES = 1 << 16


def key_hash(columns: list[str], seed: int = SEED) -> Column:
    """A whole number from 0 to 16^15 - 1 from the text of some columns; NULL has a text of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def cuts(hashed: DataFrame, by: list[str], order: str, size: Column) -> DataFrame:
    """Per group the value ``_cut`` of a hash, ``order``, up to which rows are chosen, and how many of those that hold it (``_left``).

    ``size`` is the number of rows to choose, from ``_total``, the rows of the group.
    """
    sliced = hashed.select(*by, order, F.shiftright(order, 4 * DIGITS - SLICE_BITS).alias("_cut"))
    counted = stage(sliced.groupBy(*by, "_cut").agg(F.count(F.lit(1)).alias("n")), "slices")
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_total")).withColumn("_size", F.least(F.greatest(size, F.lit(0)), F.col("_total")))
    # Written, so that its size is known where it meets all rows.
    slices = stage(_holding(counted, totals, by, "_cut").withColumnRenamed("_left", "_size"), "cuts")
    inside = null_safe_join(sliced, slices.drop("_size"), [*by, "_cut"], "inner").groupBy(*by, order).agg(F.count(F.lit(1)).alias("n"))
    return _holding(stage(inside, "frequencies"), slices.select(*by, "_size"), by, order).withColumnRenamed(order, "_cut")


def _holding(counted: DataFrame, sizes: DataFrame, by: list[str], order: str) -> DataFrame:
    """Per group the value of ``order`` that holds the ``_size``-th row, and how many rows up to that come from the value (``_left``)."""
    ranked = running_totals(counted, by, order, ["n"])
    sized = null_safe_join(ranked, sizes, by, "inner") if by else ranked.withColumn("_size", sizes.select("_size").scalar())
    before = F.col("n_upto") - F.col("n")
    inside = sized.where((before < F.col("_size")) & (F.col("_size") <= F.col("n_upto")))
    return inside.select(*by, order, (F.col("_size") - before).alias("_left"))


def choose(df: DataFrame, by: list[str], size: Column, keys: list[str] | None = None, name: str = "chosen", seed: int = SEED) -> DataFrame:
    """Rows with a flag: true for exactly ``size`` rows of each group, or all if it has fewer.

    ``size`` may use ``_total``, the rows of the group. ``keys`` (default: all
    columns) are what is hashed. Among rows with equal keys those with the smaller
    hash of the whole row come first; of rows that are equal in all columns it does
    not matter which are chosen, so they are counted and given back in that number.
    A NULL in ``by`` is a group of its own; without ``by`` the table is one group.
    """
    reserved = [c for c in df.columns if c in (name, "_hash", "_cut", "_left", "_total", "_size", "_again", "_n", "_upto")]
    if reserved:
        raise ValueError(f"columns {reserved} have names that the sample needs")
    columns = df.columns
    hashed = stage(df.withColumn("_hash", key_hash(keys or columns, seed)), "hashed")
    marked = _at_cut(hashed, stage(cuts(hashed, by, "_hash", size), "cuts"), by)
    below = F.coalesce(F.col("_hash") < F.col("_cut"), F.lit(False))
    tied = F.col("_hash") == F.col("_cut")
    sure = marked.where(~F.coalesce(tied, F.lit(False))).select(*columns, below.alias(name))
    # Rows at the cut: one a group, unless a key is repeated. Equal rows are one row with a number.
    ties = marked.where(tied).groupBy(*columns, "_left").agg(F.count(F.lit(1)).alias("_n"))
    ties = stage(ties.withColumn("_again", key_hash(columns, seed + 1)), "ties")
    per_hash = ties.groupBy(*by, "_again").agg(F.sum("_n").alias("n"))
    upto = running_totals(per_hash, by, "_again", ["n"]).select(*by, "_again", (F.col("n_upto") - F.col("n")).alias("_upto"))
    placed = null_safe_join(ties, upto, [*by, "_again"], "inner")
    taken = F.least(F.greatest(F.col("_left") - F.col("_upto"), F.lit(0)), F.col("_n"))
    parts = placed.select(*columns, "_n", taken.alias("_size"), F.explode(F.sequence(F.lit(1), F.col("_n"), F.lit(COPIES))).alias("_upto"))
    last = F.least(F.col("_upto") + (COPIES - 1), F.col("_n"))
    each = parts.hint("rebalance").select(*columns, "_size", F.explode(F.sequence(F.col("_upto"), last)).alias("_again"))
    return sure.unionByName(each.select(*columns, (F.col("_again") <= F.col("_size")).alias(name)))


def _at_cut(hashed: DataFrame, cut: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return null_safe_join(hashed, cut, by, "left")
    one = cut.agg(F.max(F.struct("_cut", "_left"))).scalar()
    return hashed.withColumn("_at", one).select(*hashed.columns, "_at._cut", "_at._left")


def share_of(share: float) -> Column:
    """Rows of a group that make up a share of it, rounded down."""
    return F.floor(F.col("_total") * F.lit(share).cast("decimal(10,9)")).cast("long")


def exact_split(
    df: DataFrame, by: list[str], test_share: float, complete: list[str] = (), keys: list[str] | None = None, thin: float | None = None, seed: int = SEED,
) -> DataFrame:
    """Complete cases, thinned to an exact share if wished, with ``is_test``: false for exactly the other share of each group.

    As with draws one after the other, sizes are rounded down: of the rows first, of the training rows then.
    """
    kept = df.dropna(subset=list(complete)) if complete else df
    if thin is not None:
        kept = choose(kept, by, share_of(thin), keys, "chosen", seed + 1).where("chosen").drop("chosen")
    train = choose(kept, by, share_of(round(1 - test_share, 9)), keys, "is_train", seed)
    return train.select(*df.columns, (~F.col("is_train")).alias("is_test"))
