"""TF-IDF: stored term counts, fitted idf tables, vectors, and cosine similarity to reference texts.

A corpus is tokenised once: the terms of some rows at a time are counted without a shuffle and stored in
blocks, one row per term with the ids and counts of the texts that hold it. Document frequencies, text norms,
vectors and every similarity read these. Blocks meet other tables by term and are taken apart behind the join,
so a term is shuffled once per block and not once per text. Joins by term have one row per term on the other
side and carry no hint: Spark broadcasts a side that turns out small and splits a frequent term otherwise.
Every function takes blocks or rows (id, term, tf).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siftwork.functions.stopwords import ENGLISH
from siftwork.functions.text import spaced_words
from siftwork.sources.durable import durable


@dataclass(frozen=True)
class IdfTable:
    """Fitted idf: ``terms(term, df, idf)`` in the shared folder, over so many texts."""

    terms: DataFrame
    n_docs: int
    stop_words: tuple[str, ...] = ENGLISH


def keys_of(id_col: str | Sequence[str]) -> list[str]:
    return [id_col] if isinstance(id_col, str) else list(id_col)


#: The column of blocks that has the ids and counts of a term, and the bytes of text that make blocks at a time.
HELD = "_held"
BLOCK_BYTES = 1 << 24


def taken_apart(counts: DataFrame) -> DataFrame:
    """Blocks as rows (id, tf, and the columns beside them); rows stay as they are."""
    if HELD not in counts.columns:
        return counts
    return counts.select(*[c for c in counts.columns if c != HELD], F.inline(HELD))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """Rows (term, df): in how many texts each term occurs, counted on the map side first."""
    texts = F.size(HELD).cast("long") if HELD in counts.columns else F.lit(1).cast("long")
    return counts.groupBy("term").agg(F.sum(texts).alias("df"))


def smooth_idf(df: Column, n_docs: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def fit_idf(
    corpus: DataFrame,
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH,
    counts: DataFrame | None = None,
) -> IdfTable:
    """Count document frequencies once and keep the idf table in the shared folder.

    ``counts`` are the stored term counts of this corpus, if there are any.
    """
    if counts is None:
        counts = term_blocks(corpus.select(F.lit(0).alias("_row"), text_col), "_row", text_col, stop_words)
    n_docs = corpus.count()
    idf = smooth_idf(F.col("df"), F.lit(float(n_docs)))
    terms = durable(document_frequencies(counts).withColumn("idf", idf), "idf")
    return IdfTable(terms, n_docs, tuple(stop_words))


def _blocks(stop_words: Sequence[str], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, ids and counts) of (ids, words of a text with spaces between them)."""
    stopped, held = list(stop_words), HELD

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = pa.array(stopped, pa.string())
        for batch in batches:
            *keys, texts = batch.columns
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
                split = pc.split_pattern(texts.slice(at, to - at), " ")
                coded = split.flatten().dictionary_encode()
                terms, codes = coded.dictionary, coded.indices.to_numpy()
                fine = pc.and_(pc.greater_equal(pc.utf8_length(terms), 2), pc.invert(pc.is_in(terms, value_set=stops)))
                fine = fine.to_numpy(zero_copy_only=False)[codes]
                owner = pc.list_parent_indices(split).to_numpy()[fine].astype(np.int64)
                entries, tf = np.unique(codes[fine].astype(np.int64) * (to - at) + owner, return_counts=True)
                code, owner = np.divmod(entries, to - at)
                first = np.flatnonzero(np.diff(code, prepend=-1))
                places = pa.array(owner + at)
                parts = [*[k.take(places) for k in keys], pa.array(tf.astype(np.int32))]
                texts_of = pa.StructArray.from_arrays(parts, names=[*batch.schema.names[:-1], "tf"])
                bounds = pa.array(np.append(first, len(code)).astype(np.int32))
                columns = [terms.take(pa.array(code[first])), pa.ListArray.from_arrays(bounds, texts_of)]
                yield pa.RecordBatch.from_arrays(columns, names=["term", held])
                at = to

    return rows


def term_blocks(
    corpus: DataFrame,
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """Rows (term, ids and tf of texts that hold it), one per distinct term of some rows of the corpus.

    Blocks are made of texts of some BLOCK_BYTES, cut between rows.
    """
    given = corpus.select(*keys_of(id_col), spaced_words(text_col).alias("_words"))
    entry = StructType([*given.schema.fields[:-1], StructField("tf", IntegerType())])
    schema = StructType([StructField("term", StringType()), StructField(HELD, ArrayType(entry))])
    return given.mapInArrow(_blocks(stop_words, BLOCK_BYTES), schema)


def term_counts(
    corpus: DataFrame,
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """Rows (id, term, tf), one per distinct term of a text."""
    blocks = term_blocks(corpus, id_col, text_col, stop_words)
    return taken_apart(blocks).select(*keys_of(id_col), "term", "tf")


def stored_counts(
    corpus: DataFrame,
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    stop_words: Sequence[str] = ENGLISH,
) -> DataFrame:
    """The term counts of a corpus as stored blocks: the only time its texts are tokenised."""
    return durable(term_blocks(corpus, id_col, text_col, stop_words), "term-counts")


def raw_weights(counts: DataFrame, idf: IdfTable, id_col: str | Sequence[str] = "doc_id") -> DataFrame:
    """Rows (id, term, raw) of tf x idf; terms that the idf doesn't know are left out."""
    raw = (F.col("tf") * F.col("idf")).alias("raw")
    met = taken_apart(counts.join(idf.terms.select("term", "idf"), "term"))
    return met.select(*keys_of(id_col), "term", raw)


def vectors(
    counts: DataFrame, idf: IdfTable, id_col: str | Sequence[str] = "doc_id"
) -> DataFrame:
    """Rows (id, term, x) of the L2-normalised TF-IDF vectors of counts that are in no index."""
    return _unit_length(raw_weights(counts, idf, id_col), keys_of(id_col))


def _unit_length(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The weight of each posting, divided by the length of its text's vector."""
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "term", (F.col("raw") / norm).alias("x"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def text_list(spark: SparkSession, texts: Sequence[str], name: str = "text") -> DataFrame:
    """A small driver-side list as a local table (ref_id, text)."""
    table = pa.table(
        {
            "ref_id": pa.array(range(len(texts)), pa.int64()),
            name: pa.array(list(texts), pa.string()),
        }
    )
    return spark.createDataFrame(table)


REFERENCE_KEYS = ["_name", "ref_id"]


def reference_counts(
    spark: SparkSession,
    references: Mapping[str, DataFrame | Sequence[str]],
    stop_words: Sequence[str],
    text_col: str = "text",
) -> DataFrame:
    """Stored term counts (_name, ref_id, term, tf) of references: lists of texts or tables (ref_id, text)."""
    tables = [
        (texts if isinstance(texts, DataFrame) else text_list(spark, texts, text_col)).select(
            F.lit(name).alias("_name"), "ref_id", text_col
        )
        for name, texts in references.items()
    ]
    return durable(term_counts(_union(tables), REFERENCE_KEYS, text_col, stop_words), "reference-counts")


def reference_vectors(counts: DataFrame, idf: IdfTable, names: Sequence[str]) -> DataFrame:
    """Rows (term, one column per name): mean TF-IDF vectors of the references, scaled to length 1.

    Scaling makes the division by the number of references superfluous: a cosine does not see it.
    """
    # References are few as a rule; without a hint Spark broadcasts them when their size allows.
    pulled = _unit_length(raw_weights(counts, idf, REFERENCE_KEYS), REFERENCE_KEYS)
    summed = durable(
        pulled.groupBy("_name", "term").agg(F.sum("x").alias("x")), "reference-vectors"
    )
    lengths = summed.groupBy("_name").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    scaled = summed.join(F.broadcast(lengths), "_name")  # one row per reference list
    return scaled.groupBy("term").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("x") / F.col("length"))).alias(name) for name in names]
    )


def text_norms(
    counts: DataFrame, idf: IdfTable, id_col: str | Sequence[str] = "doc_id"
) -> DataFrame:
    """Rows (id, norm): the length of each text's vector, stored.

    The one join of all counts with the idf table. Squares are summed per text before they are
    shuffled. Every similarity feature over the same corpus and idf reuses the norms.
    """
    raw = F.col("raw")
    lengths = raw_weights(counts, idf, id_col).groupBy(*keys_of(id_col))
    return durable(lengths.agg(F.sqrt(F.sum(raw * raw)).alias("norm")), "text-norms")


def similarities(
    counts: DataFrame,
    idf: IdfTable,
    references: Mapping[str, DataFrame | Sequence[str]],
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    norms: DataFrame | None = None,
) -> DataFrame:
    """Rows (id, one similarity column per name) for texts that share a term with the references.

    ``counts`` are the stored term counts. All features are computed in one pass that only meets the
    terms of the references. Texts without any of them are missing; their similarity is 0. ``norms``
    are the ``text_norms`` of these counts and idf, if they are stored.
    """
    keys = keys_of(id_col)
    own = reference_counts(counts.sparkSession, references, idf.stop_words, text_col)
    if norms is None:
        norms = text_norms(counts, idf, keys)
    return similarities_of(counts, idf, own, list(references), keys, norms)


def similarities_of(
    counts: DataFrame, idf: IdfTable, references: DataFrame, names: Sequence[str], keys: Sequence[str], norms: DataFrame
) -> DataFrame:
    """The same of references that are counted already."""
    columns = {name: f"_ref{position}" for position, name in enumerate(names)}
    numbers = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    own = references.withColumn("_name", numbers[F.col("_name")])
    pulled = reference_vectors(own, idf, list(columns.values()))
    weights = pulled.join(idf.terms.select("term", "idf"), "term")
    weights = weights.select("term", *[(F.col("idf") * F.col(c)).alias(c) for c in columns.values()])
    products = [F.sum(F.col("tf") * F.col(c)).alias(c) for c in columns.values()]
    totals = taken_apart(counts.join(weights, "term")).groupBy(*keys).agg(*products)
    found = [
        (F.coalesce(F.col(c), F.lit(0.0)) / F.col("norm")).alias(name) for name, c in columns.items()
    ]
    return totals.join(norms, list(keys)).select(*keys, *found)
