"""The package on the executors, and tables that outlive them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from siftwork.sources.durable import new_path, shared_folder

__all__ = ["drop", "durable", "new_path", "packed", "shared_folder", "ship"]

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, as --py-files would."""
    context = spark.sparkContext
    if getattr(context, "_siftwork_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="siftwork-package-")  # Spark serves the file from the driver
    path = os.path.join(folder, "siftwork.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for base, _, names in sorted(os.walk(PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    context._siftwork_shipped = True


#: Whether Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Have shuffle files of the queries inside deleted when they end; their results are stored tables."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: The folders of tables that were stored here, as long as their DataFrames live.
_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def durable(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Compute a table once, keep it in the shared folder and read it from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned_up(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def packed(df: DataFrame, name: str) -> DataFrame:
    """Like durable, in a denser format, for tables that carry texts."""
    return durable(df, name, compression="zstd")


def drop(*stored: DataFrame) -> None:
    """Delete tables that durable or packed returned, once all that was made of them is stored itself."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
