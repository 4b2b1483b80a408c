"""A stored text index: what TF-IDF needs of a corpus, computed once and read by every later feature.

The corpus is tokenised when it is indexed and never again. The index keeps

- postings in blocks (term, ids and tf) in the order of terms, so that a similarity reads only those of its
  references' terms: files, row groups and pages of other terms are skipped by their statistics;
- the document frequency of each term, by part, and the idf over all parts;
- the length of each text's vector.

Blocks are dealt out by ranges of (term, hash of the first id), so a term that a third of all texts hold fills
several files instead of one task.

A corpus grows by parts. Indexing more rows tokenises only these and adds their document frequencies to those
that are there; idf and lengths, which any new text changes for all, follow from the stored postings. Each
version is listed once it is complete; readers of an earlier one are not disturbed.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.stopwords import ENGLISH
from siftwork.operators.tfidf import (
    HELD,
    IdfTable,
    document_frequencies,
    keys_of,
    raw_weights,
    reference_counts,
    similarities_of,
    smooth_idf,
    stored_counts,
    taken_apart,
)
from siftwork.sources.durable import shared_folder
from siftwork.sources.manifest import File, files_digest, files_of

#: References with more terms than this are met by a join alone, which reads all postings.
LOOKUP_TERMS = 10_000
#: The terms to be read are given to the scan as so many ranges; the join leaves out what else lies in them.
RANGES = 24
VERSIONS = (
    "listed_at double, version string, keys array<string>, text_col string, stop_words array<string>, "
    "n_docs bigint, parts array<string>, files array<struct<path: string, size: bigint, changed: string>>"
)


@dataclass(frozen=True)
class TextIndex:
    """A version of an index; its tables lie under ``path``."""

    spark: SparkSession
    path: str
    version: str
    keys: tuple[str, ...]
    text_col: str
    stop_words: tuple[str, ...]
    n_docs: int
    parts: tuple[str, ...]
    files: tuple[File, ...] = ()

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf) over all parts."""
        return self.spark.read.parquet(f"{self.path}/terms-{self.version}")

    @property
    def idf(self) -> IdfTable:
        return IdfTable(self.terms, self.n_docs, self.stop_words)

    @property
    def blocks(self) -> DataFrame:
        """(term, ids and tf) of all parts."""
        return self.spark.read.parquet(*[f"{self.path}/postings-{part}" for part in self.parts])

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf) of all parts."""
        return taken_apart(self.blocks).select(*self.keys, "term", "tf")

    @property
    def norms(self) -> DataFrame:
        """(id, norm): the length of each text's vector."""
        return self.spark.read.parquet(f"{self.path}/norms-{self.version}")

    def vectors(self) -> DataFrame:
        """(id, term, x) of the vectors of length 1.

        Postings meet the idf by term and the stored lengths by id; nothing is summed again.
        """
        weights = raw_weights(self.blocks, self.idf, self.keys)
        return weights.join(self.norms, list(self.keys)).select(
            *self.keys, "term", (F.col("raw") / F.col("norm")).alias("x")
        )

    def similarities(self, references: Mapping[str, DataFrame | Sequence[str]]) -> DataFrame:
        """(id, one similarity column per name) of texts that share a term with the references.

        Reads the postings and the idf of the references' terms, and the lengths.
        """
        own = reference_counts(self.spark, references, self.stop_words, self.text_col)
        found = own.select("term").distinct().limit(LOOKUP_TERMS + 1).collect()
        terms, blocks = self.terms, self.blocks
        if len(found) <= LOOKUP_TERMS:
            wanted = in_ranges("term", sorted(r.term for r in found))
            terms, blocks = terms.where(wanted), blocks.where(wanted)
        idf = IdfTable(terms, self.n_docs, self.stop_words)
        return similarities_of(blocks, idf, own, list(references), self.keys, self.norms)


def in_ranges(column: str, values: Sequence, ranges: int = RANGES) -> Column:
    """Whether a column lies in one of some ranges that hold all of the sorted values.

    Ranges reach the scan, which skips what lies between them; a list of more than ten values would reach it
    as one range from the least to the greatest.
    """
    size = max(1, -(-len(values) // ranges))
    test = F.lit(False)
    for at in range(0, len(values), size):
        part = values[at : at + size]
        test |= F.col(column).between(part[0], part[-1])
    return test


def build_index(
    corpus: DataFrame,
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH,
    path: str | None = None,
    files: Sequence[File] = (),
) -> TextIndex:
    """Index a corpus under a path, by default a new one in the shared folder."""
    spark = corpus.sparkSession
    path = path or f"{shared_folder(spark)}/text-index-{uuid4().hex}"
    empty = TextIndex(spark, path, "", tuple(keys_of(id_col)), text_col, tuple(stop_words), 0, ())
    return extend_index(empty, corpus, files)


def extend_index(index: TextIndex, corpus: DataFrame, files: Sequence[File] = ()) -> TextIndex:
    """A further version that covers more rows, whose ids are not in the index yet."""
    spark, part, version = index.spark, uuid4().hex, uuid4().hex
    counts = stored_counts(corpus, index.keys, index.text_col, index.stop_words)
    ordered = counts.repartitionByRange("term", F.xxhash64(F.get(HELD, F.lit(0)))).sortWithinPartitions("term")
    ordered.write.parquet(f"{index.path}/postings-{part}")
    # a term lies in few of the ordered files, so few partial sums are shuffled
    ordered = spark.read.parquet(f"{index.path}/postings-{part}")
    document_frequencies(ordered).write.parquet(f"{index.path}/df-{part}")
    parts = (*index.parts, part)
    n_docs = index.n_docs + corpus.count()
    grown = TextIndex(
        spark, index.path, version, index.keys, index.text_col, index.stop_words, n_docs, parts, tuple(files)
    )
    df = spark.read.parquet(*[f"{index.path}/df-{p}" for p in parts])
    summed = df.groupBy("term").agg(F.sum("df").alias("df")) if len(parts) > 1 else df
    summed = summed.withColumn("idf", smooth_idf(F.col("df"), F.lit(float(n_docs))))
    summed.sortWithinPartitions("term").write.parquet(f"{index.path}/terms-{version}")
    raw = F.col("raw")
    lengths = raw_weights(grown.blocks, grown.idf, grown.keys).groupBy(*grown.keys)
    lengths.agg(F.sqrt(F.sum(raw * raw)).alias("norm")).write.parquet(f"{index.path}/norms-{version}")
    entry = (
        time.time(), version, list(grown.keys), grown.text_col, list(grown.stop_words), n_docs, list(parts), list(files)
    )
    spark.createDataFrame([entry], VERSIONS).coalesce(1).write.mode("append").json(f"{index.path}/versions")
    return grown


def open_index(spark: SparkSession, path: str, version: str | None = None) -> TextIndex | None:
    """The latest version under a path, or the named one; None if there is none."""
    try:
        listed = spark.read.schema(VERSIONS).json(f"{path}/versions")
    except AnalysisException:  # nothing has been listed yet
        return None
    if version is not None:
        listed = listed.where(F.col("version") == version)
    row = listed.orderBy(F.desc("listed_at")).first()
    if row is None:
        return None
    files = tuple((f.path, f.size, f.changed) for f in row.files)
    return TextIndex(
        spark, path, row.version, tuple(row["keys"]), row.text_col, tuple(row.stop_words), row.n_docs,
        tuple(row.parts), files,
    )


def corpus_index(
    spark: SparkSession,
    corpus_path: str,
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH,
    folder: str | None = None,
) -> TextIndex:
    """The index of a stored Parquet corpus, kept in the shared folder.

    The first call builds it. A later one finds it by the corpus's path and compares the files: where none has
    changed it is used as it is, where files were added only their rows are indexed, and where a file has
    changed or gone the corpus is indexed anew.
    """
    keys = keys_of(id_col)
    name = sha256("\n".join([corpus_path, *keys, text_col, *stop_words]).encode()).hexdigest()[:24]
    path = f"{folder or shared_folder(spark)}/text-index-{name}"
    files = files_of(spark, corpus_path)
    known = open_index(spark, path)
    if known is not None and files_digest(known.files) == files_digest(files):
        return known
    if known is not None and set(known.files) < set(files):
        added = [file for file, *_ in sorted(set(files) - set(known.files))]
        return extend_index(known, spark.read.parquet(*added).select(*keys, text_col), files)
    corpus = spark.read.parquet(corpus_path).select(*keys, text_col)
    return build_index(corpus, keys, text_col, stop_words, path, files)
