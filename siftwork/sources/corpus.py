"""Loading a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = "_label"
PREDICTION = "_pred"


def with_default_label(df: DataFrame) -> DataFrame:
    """Add the label column, -1 everywhere, unless the table brings its own."""
    if LABEL in df.columns:
        return df
    return df.withColumn(LABEL, F.lit(-1))


def load_corpus(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """Read a table and give it a label column."""
    return with_default_label(spark.read.format(source_format).load(path))
