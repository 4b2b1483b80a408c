"""Tables that outlive the executors that computed them."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch one only in local mode without the setting."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="siftwork-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Compute a table once, keep it in the shared folder and read it from there.

    Cuts the lineage: a lost executor costs a re-read instead of a recomputation, and later jobs read
    only the columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
