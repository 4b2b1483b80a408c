"""Slices of a total order: first pages by their top rows, deeper ones by stored ranks.

Nulls sort last in both directions. The order must end in a unique key.

The first rows are what every task's own first rows merge to; nothing is stored. For any other slice the keys
of the order are stored once, range-partitioned and sorted. A file then holds consecutive ranks, and the row
counts of the files, summed up, say which one or two files a page lies in, whatever its number.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from siftwork.sources.durable import new_path, shared_folder
from siftwork.sources.manifest import files_digest, files_of, remembered

#: Slices that end within so many rows are taken from the top of the order, by all tasks at once.
FIRST_ROWS = 1_000

# (column name, descending)
Order = Sequence[tuple[str, bool]]


def sort_columns(order: Order) -> list[Column]:
    return [
        F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()
        for name, descending in order
    ]


def _number(file: str) -> tuple[int, str]:
    """Spark's part files by the partition they were written by."""
    return int(file.split("-")[1]), file


@dataclass(frozen=True)
class Ranks:
    """The stored keys of an order: files in the order of their rows, and how many rows each holds."""

    spark: SparkSession
    path: str
    order: tuple[tuple[str, bool], ...]
    files: tuple[tuple[str, int], ...]

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.order]

    def slice(self, offset: int, count: int | None) -> DataFrame:
        """Keys with their 0-based rank, `count` of them or all that follow; only their files are read."""
        end = sum(rows for _, rows in self.files) if count is None else offset + count
        begins, passed = {}, 0
        for file, rows in self.files:
            if passed < end and passed + rows > offset:
                begins[file] = passed
            passed += rows
        if not begins:
            return self.spark.read.parquet(self.path).select(F.lit(0).cast("bigint").alias("rank"), *self.names).limit(0)
        found = self.spark.read.parquet(*[f"{self.path}/{file}" for file in begins])
        begin = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])[F.col("_metadata.file_name")]
        ranked = found.select((begin + F.col("_metadata.row_index")).cast("bigint").alias("rank"), *self.names)
        return ranked.where((F.col("rank") >= offset) & (F.col("rank") < end))

    def rows(self, df: DataFrame, offset: int, count: int | None) -> DataFrame:
        """The rows of a slice in their order."""
        self._check(offset, count)
        keys = self.slice(offset, count).toDF("_rank", *[f"_key{i}" for i in range(len(self.order))])
        same = [F.col(name).eqNullSafe(F.col(f"_key{i}")) for i, name in enumerate(self.names)]
        matched = same[0]
        for condition in same[1:]:
            matched &= condition
        return df.join(keys, matched).orderBy("_rank").select(*df.columns)

    def _check(self, offset: int, count: int | None) -> None:
        """Refuse a slice at whose begin or end two rows have the same key."""
        edges = [offset] if count is None else [offset, offset + count]
        around = self.slice(max(0, offset - 1), None if count is None else count + 2)
        wanted = sorted({rank for edge in edges for rank in (edge - 1, edge)})
        keys = {rank: tuple(key) for rank, *key in around.where(F.col("rank").isin(wanted)).collect()}
        if any(edge - 1 in keys and keys[edge - 1] == keys.get(edge) for edge in edges):
            raise ValueError(f"the order by {self.names} doesn't end in a unique key")


def _written(df: DataFrame, order: Order, path: str) -> list[tuple[str, int]]:
    columns = sort_columns(order)
    keys = df.select(*[name for name, _ in order])
    keys.repartitionByRange(*columns).sortWithinPartitions(*columns).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    counts = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    found: list[Row] = counts.collect()  # one row per file
    return sorted(((r.file, r.rows) for r in found), key=lambda entry: _number(entry[0]))


def store_ranks(df: DataFrame, order: Order, path: str | None = None) -> Ranks:
    """Store the keys of an order once, for any number of slices."""
    spark = df.sparkSession
    path = path or new_path(spark, "ranks")
    return Ranks(spark, path, tuple(order), tuple(_written(df, order, path)))


def corpus_ranks(spark: SparkSession, corpus_path: str, order: Order, folder: str | None = None) -> Ranks:
    """The ranks of a stored Parquet table, kept in the shared folder while its files stay the same."""
    key = files_digest([*files_of(spark, corpus_path), *[(name, int(descending), "") for name, descending in order]])
    place = f"{folder or shared_folder(spark)}/ranks-{key[:24]}"

    def make() -> str:
        path = f"{place}/{new_path(spark, 'keys').rsplit('/', 1)[1]}"
        return json.dumps([path, _written(spark.read.parquet(corpus_path), order, path)])

    path, files = json.loads(remembered(spark, place, make))
    return Ranks(spark, path, tuple(order), tuple((file, rows) for file, rows in files))


def take_slice(
    df: DataFrame,
    order: Order,
    offset: int,
    count: int | None,
    first_rows: int = FIRST_ROWS,
    ranks: Ranks | None = None,
) -> DataFrame:
    """Rows offset .. offset + count of the order, a page; all that follow when count is None.

    `ranks` are the stored ranks of this table and order, if there are any.
    """
    ordered = df.orderBy(*sort_columns(order))
    if count is None and not offset:
        return ordered
    if ranks is None and count is not None and offset + count <= first_rows:
        return ordered.offset(offset).limit(count)
    return (ranks or store_ranks(df, order)).rows(df, offset, count)
