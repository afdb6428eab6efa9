"""Connected components of a table of links, by contraction on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.session import stage


def _shortened(parents: DataFrame) -> DataFrame:
    """Every node's root: pointers are doubled until none changes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("further"))
        doubled = stage(
            parents.join(up, "parent", "left").select(
                "node", F.coalesce("further", "parent").alias("parent"),
                (F.col("further").isNotNull() & (F.col("further") != F.col("parent"))).alias("moved"),
            ), "parents",
        )
        parents = doubled.select("node", "parent")
        if doubled.where("moved").isEmpty():
            return parents


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and the ``label`` of its component, for the nodes of the links.

    Each round hooks every node to its smallest neighbour, follows the pointers
    to their roots, and goes on with the links between roots; rounds grow with
    the logarithm of the size. A node with very many links is reduced by the
    map tasks before its rows meet, and joins split it (adaptive skew join),
    since both of their sides are written tables. Nothing is collected.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct()
    ends = stage(ends, "ends")
    levels: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            ends.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        hooked = both.groupBy("node").agg(F.min("other").alias("other"))
        parents = stage(hooked.select("node", F.least("node", "other").alias("parent")), "hooked")
        parents = _shortened(parents)
        levels.append(parents)
        root_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("root_a"))
        root_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("root_b"))
        ends = stage(
            ends.join(root_a, "a").join(root_b, "b").where("root_a != root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(),
            "ends",
        )
    if not levels:
        return ends.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = levels[0].select("node", F.col("parent").alias("label"))
    for upper in levels[1:]:
        up = upper.select(F.col("node").alias("label"), F.col("parent").alias("further"))
        out = stage(out.join(up, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
    return out
