"""A label ledger fed by a stream of label events.

A batch is written to a folder of its own and listed afterwards. Readers take what is listed: a batch that is
being written, or whose writer died, is not there for them, and a retried batch replaces its earlier attempt
for new readers at the moment it is listed, while the earlier files stay for those that are reading them.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from hashlib import md5
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork.operators.labels import compact_events

COMMITS = "listed_at double, run string, batch bigint, folder string"
VERSIONS = "listed_at double, folder string, folded array<struct<run: string, last: bigint>>"


def write_label_stream(events: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Append event batches (seq, id, text, label) to the ledger until the source is drained.

    A batch is known by its query and number, so a retried batch is not counted twice. State is derived from the
    ledger on reading, which makes the order in which batches arrive irrelevant.
    """
    run = md5(checkpoint.encode("utf-8")).hexdigest()

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, ledger, run, number)

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_batch(batch: DataFrame, ledger: str, run: str, number: int) -> str:
    """Write one batch and list it; returns its folder."""
    folder = f"events/{run}-{number}-{uuid4().hex}"
    batch.write.parquet(f"{ledger}/{folder}")
    _listed(batch.sparkSession, [(time.time(), run, int(number), folder)], COMMITS, f"{ledger}/commits")
    return folder


def _listed(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def _entries(spark: SparkSession, path: str, schema: str) -> list[Row]:
    """What is listed, the latest entry first; one entry per batch or version."""
    try:
        return spark.read.schema(schema).json(path).orderBy(F.desc("listed_at")).collect()
    except AnalysisException:  # nothing has been listed yet
        return []


def latest_version(spark: SparkSession, ledger: str) -> Row | None:
    """The last listed compaction, if there was one."""
    return next(iter(_entries(spark, f"{ledger}/versions", VERSIONS)), None)


def _live(spark: SparkSession, ledger: str) -> tuple[Row | None, dict[tuple[str, int], str]]:
    """The last compaction, and the folder of each batch that is not folded into it."""
    version = latest_version(spark, ledger)
    folded = {part.run: part.last for part in version.folded} if version else {}
    batches: dict[tuple[str, int], str] = {}
    for entry in _entries(spark, f"{ledger}/commits", COMMITS):
        if entry.batch > folded.get(entry.run, -1):
            batches.setdefault((entry.run, entry.batch), entry.folder)
    return version, batches


def _read(spark: SparkSession, ledger: str, folders: Sequence[str]) -> DataFrame:
    if not folders:
        raise ValueError(f"nothing has been written to the ledger {ledger}")
    return spark.read.parquet(*[f"{ledger}/{folder}" for folder in folders])


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All events of a ledger that its state depends on."""
    version, batches = _live(spark, ledger)
    return _read(spark, ledger, [*([version.folder] if version else []), *batches.values()])


def compact_ledger(
    spark: SparkSession, ledger: str, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the events that still matter as a new version and list it; returns its folder.

    Readers see the version once it is listed, and until then what was there before. Batches keep
    arriving meanwhile; those behind the last batch folded in are read beside the version.
    """
    version, batches = _live(spark, ledger)
    folded = {part.run: part.last for part in version.folded} if version else {}
    for run, number in batches:
        folded[run] = max(number, folded.get(run, -1))
    rows = _read(spark, ledger, [*([version.folder] if version else []), *batches.values()])
    folder = f"events/compacted-{uuid4().hex}"
    compact_events(rows, id_col, text_col).write.parquet(f"{ledger}/{folder}")
    entry = (time.time(), folder, [(run, int(last)) for run, last in sorted(folded.items())])
    _listed(spark, [entry], VERSIONS, f"{ledger}/versions")
    return folder


def remove_folded(spark: SparkSession, ledger: str, listed_before: float | None = None) -> list[str]:
    """Delete folders that no reader of the present state needs; returns their names.

    These are earlier versions, batches folded into the last one, and attempts that a later one replaced, as far
    as they were listed before a time, by default now. Folders that are not listed, which a writer may still be
    filling, stay. Readers of an earlier state should have finished.
    """
    before = time.time() if listed_before is None else listed_before
    version, batches = _live(spark, ledger)
    live = {*batches.values(), *([version.folder] if version else [])}
    known = [*_entries(spark, f"{ledger}/commits", COMMITS), *_entries(spark, f"{ledger}/versions", VERSIONS)]
    out = sorted({entry.folder for entry in known if entry.listed_at < before} - live)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    removed = []
    for folder in out:
        path = hadoop(f"{ledger}/{folder}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path) and system.delete(path, True):
            removed.append(folder)
    return removed
