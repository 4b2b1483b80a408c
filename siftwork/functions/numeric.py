"""Number and vector functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BIN_COUNT = 50
BIN_WIDTH = 0.02


def bin_number(value: Column) -> Column:
    """Number of the right-closed bin (edge, next edge] that holds the value, null outside (0, 1].

    The quotient is at most one bin off, because edges such as 0.14 have no exact double. Comparing
    with the edges themselves settles which side the value lies on, in plain generated code.
    """
    width = F.lit(BIN_WIDTH)
    guess = F.ceil(value / width) - 1
    settled = (
        F.when(value <= guess * width, guess - 1)
        .when(value > (guess + 1) * width, guess + 1)
        .otherwise(guess)
    )
    return F.when((value > 0) & (value <= 1.0), settled)


def percent_text(share: Column) -> Column:
    """First four characters of the share as a percentage, cut and not rounded."""
    percent = share * F.lit(100.0)
    # Below 1e-3 doubles turn to scientific notation as text.
    tiny = (percent > 0) & (percent < 1e-3)
    return F.when(tiny, F.lit("0.00")).otherwise(F.substring(percent.cast("string"), 1, 4))


def share_text(share: Column, count: Column) -> Column:
    """Text such as "8.33% (1)"."""
    return F.concat(
        percent_text(share), F.lit("% ("), count.cast("bigint").cast("string"), F.lit(")")
    )


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def logistic(coefficients: Mapping[str, float], intercept: float) -> Column:
    """Probability of class 1 from feature columns and fitted coefficients."""
    margin = F.lit(float(intercept))
    for name, coefficient in coefficients.items():
        margin = margin + F.lit(float(coefficient)) * F.col(name)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _sum_doubles(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return _sum_doubles(products)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two arrays, 0.0 when either has no length."""
    return safe_ratio(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def vector_literal(values: Sequence[float]) -> Column:
    return F.lit([float(value) for value in values]).cast("array<double>")


def similarity_activation(similarity: Column, floor: float = 0.25) -> Column:
    """Stretch a cosine to 2s - 1 and zero everything under the floor."""
    stretched = similarity * 2 - 1
    return F.when(stretched < floor, F.lit(0.0)).otherwise(stretched)


def row_capped(features: Sequence[str]) -> dict[str, Column]:
    """Each feature divided by the row's feature sum where that sum is above 1."""
    total = sum((F.col(name) for name in features), F.lit(0.0))
    return {
        name: F.when(total > 1.0, F.col(name) / total).otherwise(F.col(name)) for name in features
    }
