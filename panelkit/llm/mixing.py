"""Mixing sources to target weights (operator 7) by Poisson replication.

A source's rate is its target share of the rows over its actual share. Each row
gets a count from the Poisson distribution with that mean, by inverting the
distribution function at a number drawn from a hash of the row's key and text, so
that the same row gets the same count in every run. The row is repeated that often,
and the copies are dealt over the partitions and sorted by a hash, a random order.

Everything here is DataFrame operations. The rates are a written table with a row
per source; Spark broadcasts it if its size allows, and splits a source that holds
many rows otherwise. Rows are shuffled once, by a hash and by where the row stood,
which together are different for each.

Defined results: rows without a source form a source of their own; rows that repeat
key and text get equal counts; a row without a key is drawn by where it stands in the
table, each by itself, so the same files give the same counts; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import own_name
from panelkit.session import stage

SEED = 7
#: Without given weights a source weighs its number of rows to this power.
FLATTENING = 0.5
#: A rate above this is drawn as a sum of parts, so that exp(-rate) stays far from zero.
PART = 16.0
NO_SOURCE = "(none)"


def uniform(*parts) -> Column:
    """A number in (0, 1) from a hash: 52 bits of an MD5 digest, plus a half."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(rate: Column, u: Column) -> Column:
    """The smallest k whose distribution function lies above u, for rates up to ``PART``.

    The sum runs over as many terms as a rate of ``PART`` needs to reach one in
    double precision, so no count is cut off.
    """
    terms = int(PART + 12 * PART ** 0.5 + 40)
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("below"), F.lit(0).alias("n"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(
            p.alias("p"), (state["below"] + p).alias("below"), (state["n"] + (u >= state["below"]).cast("int")).alias("n")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), first, step, lambda state: state["n"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", flattening: float = FLATTENING) -> DataFrame:
    """``source`` and ``rate``: the target share of the rows over the actual one.

    ``weights`` are relative; sources not listed weigh nothing. Without weights a
    source weighs its number of rows to the power of ``flattening``.
    """
    named = F.coalesce(F.col(source), F.lit(NO_SOURCE))
    sizes = docs.groupBy(named.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(flattening)))
    else:
        known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
        weighed = sizes.withColumn("w", F.coalesce(F.try_element_at(known, "source"), F.lit(0.0)))
    weighed = stage(weighed, "weights")
    total = weighed.agg(F.struct(F.sum("w").alias("w"), F.sum("n").alias("n"))).scalar()
    return weighed.withColumn("total", total).select(
        "source", F.coalesce(F.col("w") * F.col("total.n") / F.nullif(F.col("total.w"), F.lit(0.0)) / F.col("n"), F.lit(0.0)).alias("rate")
    )


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Rows repeated to the target weights, in a random order.

    The result has the columns of ``docs``, then ``rate`` of the source, ``copy``
    from 1 on, and ``shuffle_key``, by which each partition is sorted. Columns of
    ``docs`` with these three names are replaced.
    """
    docs = docs.drop("rate", "copy", "shuffle_key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    other, copies, digest, row = (own_name(n, docs) for n in ("mixed_source", "copies", "text_md5", "row"))
    rate = stage(rates(docs, weights, source), "rates").withColumnRenamed("source", other)
    joined = docs.join(rate, F.coalesce(docs[source], F.lit(NO_SOURCE)) == rate[other]).withColumns({
        digest: F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")),
        # Where the row stands: it tells rows apart that nothing else does.
        row: F.monotonically_increasing_id(),
    })
    identity = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.col(row)))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    drawn = F.transform(
        F.sequence(F.lit(1), parts), lambda i: poisson(F.col("rate") / parts, uniform(F.lit(seed), identity, F.col(digest), i.cast("string")))
    )
    n = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    repeated = joined.withColumn(copies, n).where(F.col(copies) > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long")))
    )
    order = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), identity, F.col(digest), F.col("copy")))
    # Rows that repeat key and text share their order, but not their partition.
    return (
        repeated.withColumn("shuffle_key", order).select(*columns, "rate", "copy", "shuffle_key", row)
        .repartition("shuffle_key", row).sortWithinPartitions("shuffle_key").drop(row)
    )
