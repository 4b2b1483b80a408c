"""Class-balanced logistic regression over feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.numeric import logistic
from siftwork.sources.corpus import LABEL, PREDICTION
from siftwork.sources.durable import durable

# Fixed values.
MIN_LABELS = 10
REGULARISATION_C = 1.0


@dataclass(frozen=True)
class FittedModel:
    """Coefficients of a fitted classifier; plain numbers, so scoring is a column expression."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float


def seed_status(training: DataFrame, label_col: str = LABEL) -> DataFrame:
    """One row: labels so far, labels still missing, classes without a label, and whether to train."""
    label = F.col(label_col)
    counted = training.agg(
        F.count(F.when(label != -1, 1)).alias("labelled"),
        F.count(F.when(label == 1, 1)).alias("interesting"),
        F.count(F.when(label == 0, 1)).alias("uninteresting"),
    )
    enough = F.col("labelled") >= MIN_LABELS
    both = (F.col("interesting") > 0) & (F.col("uninteresting") > 0)
    return counted.select(
        "*",
        F.greatest(F.lit(MIN_LABELS) - F.col("labelled"), F.lit(0)).alias("remaining"),
        (F.col("interesting") == 0).alias("needs_interesting"),
        (F.col("uninteresting") == 0).alias("needs_uninteresting"),
        (enough & both).alias("seeded"),
    )


def is_seeded(training: DataFrame, label_col: str = LABEL) -> bool:
    """At least ten labels and both classes."""
    return bool(seed_status(training, label_col).first()["seeded"])


def class_weights(training: DataFrame, label_col: str = LABEL) -> DataFrame:
    """Rows (label, n, weight) with weight = all rows / (classes x rows of the class)."""
    labelled = training.where(F.col(label_col) != -1)
    counts = labelled.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    ).scalar()
    weight = totals["rows"] / (totals["classes"] * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def fit(
    training: DataFrame,
    features: Sequence[str],
    label_col: str = LABEL,
    max_iter: int = 200,
    tol: float = 1e-10,
) -> FittedModel | None:
    """Fit P(label = 1), or None when the labels do not suffice or no feature is in the model.

    The objective is the summed log loss with balanced class weights plus half the squared
    coefficients (C = 1, intercept free). Balanced weights sum to the number of rows, so dividing by
    it gives the mean loss and a regularisation of 1 / (C rows). The labelled rows are written once,
    so that iterations read numbers and never compute features again.
    """
    if not features:
        return None
    labelled = training.where(F.col(label_col) != -1).select(*features, label_col)
    labelled = durable(labelled, "training")
    status = seed_status(labelled, label_col).first()
    if not status["seeded"]:
        return None
    n = status["labelled"]
    weight = F.when(F.col(label_col) == 1, n / (2.0 * status["interesting"])).otherwise(
        n / (2.0 * status["uninteresting"])
    )
    rows = labelled.select(
        *features, F.col(label_col).cast("double").alias("_target"), weight.alias("_weight")
    )
    assembled = VectorAssembler(inputCols=list(features), outputCol="_vector").transform(rows)
    fitted = LogisticRegression(
        featuresCol="_vector",
        labelCol="_target",
        weightCol="_weight",
        regParam=1.0 / (REGULARISATION_C * n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(assembled.select("_vector", "_target", "_weight"))
    return FittedModel(
        tuple(features), tuple(float(x) for x in fitted.coefficients), float(fitted.intercept)
    )


def score(df: DataFrame, model: FittedModel | None) -> DataFrame:
    """Add P(label = 1), computed in generated code; without a model, remove old predictions."""
    unscored = df.drop(PREDICTION)
    if model is None:
        return unscored
    weights = dict(zip(model.features, model.coefficients))
    return unscored.withColumn(PREDICTION, logistic(weights, model.intercept))


def coefficients(spark: SparkSession, model: FittedModel) -> DataFrame:
    """Rows (feature, coefficient), the intercept included."""
    rows = [("(intercept)", model.intercept), *zip(model.features, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


def chain_filter(
    df: DataFrame, models: Sequence[FittedModel], threshold: float = 0.5
) -> DataFrame:
    """Rows that pass every model's threshold, with one score column per model."""
    kept = df
    for position, model in enumerate(models):
        weights = dict(zip(model.features, model.coefficients))
        name = f"_pred_{position}"
        kept = kept.withColumn(name, logistic(weights, model.intercept)).where(
            F.col(name) > threshold
        )
    return kept
