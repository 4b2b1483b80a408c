"""What a stored table consists of: its files, with sizes and times, and a digest of its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (path, bytes, time of change)
File = tuple[str, int, str]


def files_of(spark: SparkSession, path: str) -> tuple[File, ...]:
    """The files of a stored table in the order of their names; their contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = listed.select("path", "length", F.col("modificationTime").cast("string").alias("changed"))
    return tuple(sorted((r.path, r.length, r.changed) for r in rows.collect()))


def files_digest(files: Sequence[File]) -> str:
    return sha256("\n".join(f"{path}\t{size}\t{changed}" for path, size, changed in files).encode()).hexdigest()


def rows_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """Number of rows and two sums of row hashes: the same for any order of the rows, and for no other table.

    Sums, unlike exclusive ors, also tell how often a row occurs.
    """
    hashes = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return ":".join(str(value or 0) for value in df.agg(F.count(F.lit(1)), *hashes).first())


def remembered(spark: SparkSession, place: str, make: Callable[[], str]) -> str:
    """What was made under a place, made now if nothing is listed there yet.

    It is listed once it is complete; of two that make it at once both are right, and the first listed is used.
    """
    schema = "made string"
    try:
        found = spark.read.schema(schema).json(f"{place}/made").agg(F.min("made")).first()[0]
    except AnalysisException:  # nothing has been listed yet
        found = None
    if found is None:
        found = make()
        spark.createDataFrame([(found,)], schema).coalesce(1).write.mode("append").json(f"{place}/made")
    return found
