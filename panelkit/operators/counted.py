"""Row counts around joins, taken by the job that runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from panelkit.operators.keys import null_safe_join


class JoinCounts:
    """Joins that must neither lose nor repeat rows of their left side.

    Each join is observed on both sides. The counts are there once the result has
    been written or otherwise run to its end; no extra job counts anything.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation, Observation]] = []

    def join(self, name: str, left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
        """Join on keys, NULL ones too, and count the rows before and after."""
        before, after = Observation(f"{name}, before"), Observation(f"{name}, after")
        rows = F.count(F.lit(1)).alias("n")
        joined = null_safe_join(left.observe(before, rows), right, keys, how).observe(after, rows)
        self._seen.append((name, before, after))
        return joined

    def counts(self) -> list[tuple[str, int, int]]:
        """Join, rows before, rows after. Waits for the job that runs the joins."""
        return [(name, before.get["n"], after.get["n"]) for name, before, after in self._seen]

    def check(self) -> None:
        """Fail if a join has lost or repeated rows."""
        for name, before, after in self.counts():
            if before != after:
                raise ValueError(f"join {name}: {before} rows before, {after} after, so rows were {'lost' if after < before else 'repeated'}")
