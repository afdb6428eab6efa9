"""Exact quantiles, running totals and area under the curve against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from conftest import rows
from panelkit.operators import quality, ranks, scoring


def skewed(seed: int):
    """A hot group with few values, one with many, one with a heavy tail, one of a single value, a NULL group."""
    rng = random.Random(seed)
    data = [("hot", float(rng.choice([1, 1, 1, 2, 7]))) for _ in range(4000)]
    data += [("many", rng.random()) for _ in range(3000)]
    data += [("tail", rng.random() ** -3) for _ in range(2000)]
    data += [("one", 5.0), (None, 3.0), (None, 4.0)]
    data += [("hot", None)] * 10
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_grouped_quantiles(spark, seed):
    data = skewed(seed)
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    probs = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r[0]: r[1:] for r in rows(ranks.exact_quantiles(df, ["g"], "x", probs))}
    for group in {g for g, _ in data}:
        values = [x for g, x in data if g == group and x is not None]
        assert got[group] == pytest.approx(np.quantile(values, list(probs.values())), rel=1e-12)


def test_global_summary(spark):
    data = skewed(3)
    df = spark.createDataFrame(data, "g string, x double")
    values = np.array([x for _, x in data if x is not None])
    r = quality.numeric_summary(df, "x").first()
    assert (r["min"], r["max"], r["n_null"]) == (values.min(), values.max(), 10)
    assert [r.q1, r["median"], r.q3] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75]))


def test_running_totals(spark):
    data = [(g, i, (i * 7) % 11) for g in "ab" for i in range(500)]
    df = spark.createDataFrame(data, "g string, k int, w long").repartition(5)
    got = {(r[0], r[1]): r[3] for r in rows(ranks.running_totals(df, ["g"], "k", ["w"]))}
    for g in "ab":
        total = 0
        for i in range(500):
            total += (i * 7) % 11
            assert got[(g, i)] == total


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -60.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "g string, x double")
    r = quality.box_stats(df, "x", ["g"]).first()
    assert (r.q1, r["median"], r.q3) == tuple(np.quantile(values, [0.25, 0.5, 0.75]))
    assert (r.whisker_low, r.whisker_high, r.n_outliers) == (1.0, 5.0, 2)


def test_area_under_curve_with_ties(spark):
    rng = random.Random(5)
    data = [(rng.choice([0, 1]), rng.choice([0.1, 0.2, 0.2, 0.5, rng.random()])) for _ in range(400)]
    positives = [s for o, s in data if o == 1]
    negatives = [s for o, s in data if o == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    df = spark.createDataFrame(data, "obs int, score double")
    got = scoring.area_under_curve(scoring.score_frequencies(df, "obs", "score")).first().auc
    assert got == pytest.approx(wins / (len(positives) * len(negatives)))


def test_report_counts(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.3), (0, 0.1), (0, None)], "obs int, score double")
    r = scoring.classification_report(df, "obs", "score").first()
    assert (r.n, r.tp, r.fp, r.tn, r.fn) == (4, 1, 1, 1, 1)
    assert r.mse == pytest.approx((0.01 + 0.64 + 0.09 + 0.01) / 4)
