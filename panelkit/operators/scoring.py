"""Classification by a cut-off on a score, and rescoring with a saved model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelkit.constants import CLASS_CUTOFF
from panelkit.functions import nulls
from panelkit.operators.keys import null_safe_join
from panelkit.operators.ranks import running_totals
from panelkit.operators.reshape import widen
from panelkit.session import stage


def classify(df: DataFrame, observed: str, score: str, cutoff: float = CLASS_CUTOFF) -> DataFrame:
    """Predicted class (1 above the cut-off) and which kind of hit or miss it is."""
    yes, positive = F.col(score) > cutoff, F.col(observed) == 1
    return df.withColumns({
        "pred": yes.cast("int"),
        "tn": ~positive & ~yes, "fp": ~positive & yes,
        "fn": positive & ~yes, "tp": positive & yes,
    })


def score_frequencies(df: DataFrame, observed: str, score: str) -> DataFrame:
    """Per distinct score its rows, its hits and misses, and its squared error; written once."""
    error = F.col(observed) - F.col(score)
    return stage(
        df.dropna(subset=[observed, score]).groupBy(F.col(score).alias("score")).agg(
            F.count_if(F.col(observed) == 1).alias("pos"), F.count_if(F.col(observed) == 0).alias("neg"),
            F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("square"),
        ),
        "scores",
    )


def area_under_curve(scores: DataFrame) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half.

    From :func:`score_frequencies`; the running number of negatives needs no task
    that holds all of them.
    """
    ranked = running_totals(scores, [], "score", ["neg"])
    wins = F.sum(F.col("pos") * (2 * F.col("neg_upto") - F.col("neg")))
    return ranked.agg(
        (wins / 2).alias("_wins"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")
    ).select(nulls.ratio("_wins", F.col("_pos") * F.col("_neg")).alias("auc"))


def classification_report(
    df: DataFrame, observed: str, score: str, cutoff: float = CLASS_CUTOFF
) -> DataFrame:
    """One row: rows, the confusion counts, squared error and area under the curve.

    The rows are read once, into frequencies of scores.
    """
    scores = score_frequencies(df, observed, score)
    yes, other = F.col("score") > cutoff, F.col("n") - F.col("pos")
    total = lambda c, keep: F.coalesce(F.sum(F.when(keep, c)), F.lit(0))
    return scores.agg(
        total(F.col("n"), F.lit(True)).alias("n"),
        total(F.col("pos"), yes).alias("tp"), total(other, yes).alias("fp"),
        total(other, ~yes).alias("tn"), total(F.col("pos"), ~yes).alias("fn"),
        nulls.ratio(F.sum("square"), F.sum("n")).alias("mse"),
    ).withColumn("auc", area_under_curve(scores).scalar())


def votes_of(scored: DataFrame, classes: list[str], probability: str = "probability", prefix: str = "votes_") -> DataFrame:
    """The share of votes of each class as a column of its own, from a forest's vector; 0 for a class it has never seen."""
    shares = vector_to_array(probability)
    return scored.withColumns({f"{prefix}{c}": F.coalesce(F.get(shares, F.lit(i)), F.lit(0.0)) for i, c in enumerate(classes)})


def voted_class(df: DataFrame, cutoffs: dict[str, float] | DataFrame, by: list[str] = (), prefix: str = "votes_", name: str = "pred_class") -> DataFrame:
    """The class with the largest ratio of votes to its cut-off, the first of equals in the order of the cut-offs.

    ``cutoffs`` names the classes, either with a number each or, per group, as a table
    of ``by``, ``class`` and ``cutoff``, whose classes are tried in alphabetical order. Cut-offs
    have to be above 0; as in the usual rule they need not add up to 1. A row without
    any votes, or of a group without cut-offs, has no class. A table that repeats a
    class of a group, or has a cut-off that is not above 0, is an error.
    """
    def chosen(ratios: list[tuple[str, Column, Column]]) -> Column:
        # The largest ratio first; among equal ones the smallest place.
        options = F.array(*[F.struct(F.try_divide(v, c).alias("ratio"), F.lit(-i).alias("place"), F.lit(n).alias("class"))
                            for i, (n, v, c) in enumerate(ratios)])
        return F.array_max(F.filter(options, lambda o: o["ratio"].isNotNull()))["class"]

    if isinstance(cutoffs, dict):
        if not cutoffs or min(cutoffs.values()) <= 0:
            raise ValueError("cut-offs have to be above 0")
        return df.withColumn(name, chosen([(c, F.col(f"{prefix}{c}"), F.lit(float(x))) for c, x in cutoffs.items()]))
    classes = sorted(c.removeprefix(prefix) for c in df.columns if c.startswith(prefix))
    allowed = F.when(F.col("cutoff") > 0, F.col("cutoff")).otherwise(F.raise_error(F.lit("cut-offs have to be above 0")))
    wide = widen(cutoffs.withColumn("cutoff", allowed), list(by), "class", {"_cutoff": "cutoff"}, classes)
    joined = null_safe_join(df, wide, list(by))
    found = joined.withColumn(name, chosen([(c, F.col(f"{prefix}{c}"), F.col(f"_cutoff_{c}")) for c in classes]))
    return found.drop(*[f"_cutoff_{c}" for c in classes])


def class_report(df: DataFrame, observed: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """Rows per observed and predicted class (and group), with the share of the observed class that they are."""
    counted = df.groupBy(*by, observed, predicted).agg(F.count(F.lit(1)).alias("n"))
    of_class = W.partitionBy(*by, observed)  # as many rows as there are classes
    return counted.withColumn("share", F.col("n") / F.sum("n").over(of_class))


def fit_classes(
    rows: DataFrame, observed: str, categories: list[str], numbers: list[str], trees: int = 200, depth: int = 9, seed: int = 2019,
) -> PipelineModel:
    """A classification forest for a 0/1 response; its second probability is the score."""
    indexed = [f"{c}_index" for c in categories]
    return Pipeline(stages=[
        StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep"),
        VectorAssembler(inputCols=[*indexed, *numbers], outputCol="features"),
        RandomForestClassifier(labelCol=observed, numTrees=trees, maxDepth=depth, seed=seed),
    ]).fit(rows)


def rescore(path: str, rows: DataFrame) -> DataFrame:
    """``score`` of a saved classification pipeline for new rows: the share of votes for 1."""
    scored = PipelineModel.load(path).transform(rows)
    votes = vector_to_array("probability")
    return scored.withColumn("score", F.coalesce(F.get(votes, F.lit(1)), F.lit(0.0))).select(*rows.columns, "score")
