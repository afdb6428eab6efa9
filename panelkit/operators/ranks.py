"""Running totals and exact quantiles of groups of any size.

A window ordered over a whole group puts that group into one task. Here the
values of a group are first reduced to distinct values with frequencies, then
cut into ranges of about equal size at approximate quantiles. Each range is
summed up on its own, and the totals of the ranges before it are added. The
approximation only decides where to cut; the results are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.session import stage

#: Ranges of a group at least. There are as many as a shuffle has partitions, if those are more.
RANGES = 64


def frequencies(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Distinct values of each group with their number of rows; NULL is a value too."""
    return df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def running_totals(values: DataFrame, by: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``<s>_upto``, the sum of ``s`` over the group up to and with the row.

    ``values`` is unique on (by, order). A NULL in ``by`` is a group of its own.
    Without ``by`` the whole table is one group.
    """
    ranges = max(RANGES, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = F.percentile_approx(order, steps, 1000)
    keyed = values.withColumn("_group", F.struct(*by) if by else F.lit(0))
    if by:
        cut = keyed.join(keyed.groupBy("_group").agg(cuts.alias("_cuts")), "_group")
    else:
        cut = keyed.withColumn("_cuts", values.agg(cuts).scalar())
    ranged = cut.withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    ).drop("_cuts")
    before = W.partitionBy("_group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("_group", "_range").agg(
        *[F.sum(s).alias(f"_{s}") for s in sums]
    ).select(
        "_group", "_range",
        *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
    )
    within = W.partitionBy("_group", "_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        ranged.join(offsets, ["_group", "_range"])
        .withColumns({f"{s}_upto": F.col(f"_{s}_before") + F.sum(s).over(within) for s in sums})
        .drop("_group", "_range", *[f"_{s}_before" for s in sums])
    )


def exact_quantiles(
    df: DataFrame, by: list[str], column: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, a column per named probability.

    The frequencies serve several branches, so they are written once.
    """
    return quantiles_of(stage(frequencies(df, by, column), "frequencies"), by, probs)


def quantiles_of(counted: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """The same from frequencies: the value at 0-based rank r is the one whose rows cover r."""
    counted = counted.where("value is not null")
    ranked = running_totals(counted, by, "value", ["n"])
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_size")).select(
        *[F.col(b).alias(f"_by_{b}") for b in by], "_size"
    )
    if by:
        match = F.lit(True)
        for b in by:
            match = match & ranked[b].eqNullSafe(totals[f"_by_{b}"])
        sized = ranked.join(totals, match)
    else:
        sized = ranked.withColumn("_size", totals.select("_size").scalar())
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    picks, results = [], {}
    for name, p in probs.items():
        rank = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        picks += [
            F.max(F.when((first <= low) & (low <= last), F.col("value"))).alias(f"_{name}_low"),
            F.max(F.when((first <= high) & (high <= last), F.col("value"))).alias(f"_{name}_high"),
            F.max(rank - low).alias(f"_{name}_share"),
        ]
        lower, share = F.col(f"_{name}_low"), F.col(f"_{name}_share")
        results[name] = lower + (F.col(f"_{name}_high") - lower) * share
    return sized.groupBy(*by).agg(*picks).select(*by, *[c.alias(n) for n, c in results.items()])
