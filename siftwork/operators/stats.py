"""Statistics over features and scores; each is one aggregation pass with a fixed-size result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.numeric import (
    BIN_COUNT,
    BIN_WIDTH,
    bin_number,
    safe_ratio,
    share_text,
)
from siftwork.sources.corpus import PREDICTION


def coverage(df: DataFrame, features: Sequence[str], by_class: bool | None = None) -> DataFrame:
    """One row per feature: rows it is active on, in total and by predicted class, with shares.

    Shares by class are of the rows covered. Without scores they are 0.
    """
    if by_class is None:
        by_class = PREDICTION in df.columns

    def count_where(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = [F.count(F.lit(1)).alias("_rows")]
    for position, c in enumerate(features):
        active = F.col(c) > 0
        counts.append(count_where(active).alias(f"_total{position}"))
        if by_class:
            positive = active & (F.col(PREDICTION) >= 0.5)
            negative = active & (F.col(PREDICTION) < 0.5)
            counts.append(count_where(positive).alias(f"_pos{position}"))
            counts.append(count_where(negative).alias(f"_neg{position}"))
    zero = F.lit(0).cast("bigint")
    entries = [
        F.struct(
            F.lit(c.removeprefix("_")).alias("feature"),
            F.col("_rows").alias("rows"),
            F.col(f"_total{position}").alias("total"),
            (F.col(f"_pos{position}") if by_class else zero).alias("pos"),
            (F.col(f"_neg{position}") if by_class else zero).alias("neg"),
        )
        for position, c in enumerate(features)
    ]
    rows = df.agg(*counts).select(F.inline(F.array(*entries)))
    return rows.select(
        "feature",
        "total",
        "pos",
        "neg",
        safe_ratio(F.col("total"), F.col("rows")).alias("total_pct"),
        safe_ratio(F.col("pos"), F.col("total")).alias("pos_pct"),
        safe_ratio(F.col("neg"), F.col("total")).alias("neg_pct"),
    )


def coverage_text(covered: DataFrame, seeded: bool = True) -> DataFrame:
    """Coverage as display text; class texts stay empty while there are too few labels."""
    blank = F.lit("")

    def text(share: str, count: str) -> Column:
        return share_text(F.col(share), F.col(count))

    return covered.select(
        "feature",
        text("total_pct", "total").alias("cov_text"),
        (text("pos_pct", "pos") if seeded else blank).alias("pos_text"),
        (text("neg_pct", "neg") if seeded else blank).alias("neg_text"),
    )


def histogram(df: DataFrame, value_col: str = PREDICTION) -> DataFrame:
    """Rows per score bin: 50 right-closed bins over (0, 1], empty ones included.

    Each bin enters once with a count of 0, and rows outside the range count 0 as well; so there is
    one aggregation, and neither a join nor a filter that would compute the score again. A table without
    scores has empty bins.
    """
    scored = value_col in df.columns
    number = bin_number(F.col(value_col) if scored else F.lit(None).cast("double"))
    if not scored:
        df = df.limit(0)
    placed = df.select(
        F.coalesce(number, F.lit(0)).cast("bigint").alias("_bin"),
        number.isNotNull().cast("bigint").alias("n"),
    )
    empty = df.sparkSession.range(BIN_COUNT).select(
        F.col("id").alias("_bin"), F.lit(0).cast("bigint").alias("n")
    )
    counted = placed.unionByName(empty).groupBy("_bin").agg(F.sum("n").alias("n"))
    start = F.col("_bin") * F.lit(BIN_WIDTH)
    return counted.select(
        F.col("n").alias("count"),
        F.round(start, 2).alias("bin"),
        F.round(start + BIN_WIDTH, 2).alias("bin_end"),
    )


def confusion(df: DataFrame, truth: Column, threshold: float = 0.5) -> DataFrame:
    """One row of counts of predicted against true positives."""
    predicted = F.col(PREDICTION) >= threshold
    return df.agg(
        F.count(F.when(predicted & truth, 1)).alias("tp"),
        F.count(F.when(~predicted & truth, 1)).alias("fn"),
        F.count(F.when(predicted & ~truth, 1)).alias("fp"),
        F.count(F.when(~predicted & ~truth, 1)).alias("tn"),
    )


def predicted_by_category(df: DataFrame, category: str, threshold: float = 0.5) -> DataFrame:
    """Predicted positives per category, the largest first."""
    return (
        df.where(F.col(PREDICTION) >= threshold)
        .groupBy(category)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), category)
    )
