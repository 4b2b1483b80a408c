"""Embeddings: batch embedding with a user's model, the embedding cache, pooling and similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.numeric import cosine, similarity_activation

# Fixed values.
EMBED_BATCH = 16

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed_texts(
    df: DataFrame,
    make_embedder: Callable[[], Embedder],
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """Rows (id, embedding). ``make_embedder`` loads the model, once per task.

    Null texts are not given to the model; their embedding is null.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for texts in batches:
            values = texts.tolist()
            vectors: list = [None] * len(values)
            known = [at for at, text in enumerate(values) if text is not None]
            for start in range(0, len(known), batch_size):
                batch = known[start : start + batch_size]
                for at, vector in zip(batch, embedder([values[at] for at in batch])):
                    vectors[at] = vector
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return df.select(id_col, embed(text_col).alias("embedding"))


def missing_from_cache(df: DataFrame, cache: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows without a cached embedding, decided by id alone."""
    return df.join(cache.select(id_col), id_col, "left_anti")


def extend_cache(
    df: DataFrame,
    cache: DataFrame,
    make_embedder: Callable[[], Embedder],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The cache plus embeddings of the rows it lacked; rows already cached are not embedded."""
    missing = missing_from_cache(df.select(id_col, text_col), cache, id_col)
    fresh = embed_texts(missing, make_embedder, id_col, text_col)
    return cache.select(id_col, "embedding").unionByName(fresh)


# A cache that knows texts: (text_hash, model, embedding), one row per text and model. A text that has changed has
# another hash and is embedded again; copies of a text, and a text under another id, share one vector.


def text_hash(text_col: str = "text") -> Column:
    """What stands for a text in the cache; null for null, which has no vector."""
    return F.sha2(F.col(text_col), 256)


def missing_texts(
    df: DataFrame, cache: DataFrame | None, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(text_hash, id) of texts without a vector of this model, each text once, by its smallest id.

    Only ids and hashes are shuffled, and copies are reduced ahead of it.
    """
    hashed = df.select(id_col, text_hash(text_col).alias("text_hash")).where(F.col("text_hash").isNotNull())
    firsts = hashed.groupBy("text_hash").agg(F.min(id_col).alias(id_col))
    if cache is None:
        return firsts
    known = cache.where(F.col("model") == model).select("text_hash")
    return firsts.join(known, "text_hash", "left_anti")


def extend_text_cache(
    df: DataFrame,
    cache: DataFrame | None,
    make_embedder: Callable[[], Embedder],
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = EMBED_BATCH,
) -> DataFrame:
    """The cache with vectors of this model for all texts of the table; those it has are not embedded again."""
    missing = missing_texts(df, cache, model, id_col, text_col)
    hashed = df.select(id_col, text_col, text_hash(text_col).alias("text_hash"))
    wanted = hashed.join(missing, ["text_hash", id_col], "left_semi")
    fresh = embed_texts(wanted.dropDuplicates(["text_hash"]), make_embedder, "text_hash", text_col, batch_size)
    fresh = fresh.select("text_hash", F.lit(model).alias("model"), "embedding")
    return fresh if cache is None else cache.select("text_hash", "model", "embedding").unionByName(fresh)


def cached_embeddings(
    df: DataFrame, cache: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, embedding) of the rows whose text has a vector of this model."""
    hashed = df.select(id_col, text_hash(text_col).alias("text_hash"))
    own = cache.where(F.col("model") == model).select("text_hash", "embedding")
    return hashed.join(own, "text_hash").select(id_col, "embedding")


def embedding_similarity(
    embeddings: DataFrame, reference: Column, floor: float = 0.25, id_col: str = "doc_id"
) -> DataFrame:
    """Rows (id, cosine, feature): similarity to a reference vector, raw and as a feature value.

    The reference may be a literal, a column or a scalar subquery.
    """
    paired = embeddings.select(id_col, "embedding", reference.alias("_reference"))
    raw = paired.select(id_col, cosine(F.col("embedding"), F.col("_reference")).alias("cosine"))
    return raw.withColumn("feature", similarity_activation(F.col("cosine"), floor))


def mean_pool(tokens: DataFrame, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """One mean vector per id from many token vectors.

    Sums are kept per id on the map side, so an id with very many tokens is no hot key.
    """
    vectors = tokens.select(id_col, array_to_vector(F.col(vector_col)).alias("_vector"))
    pooled = vectors.groupBy(id_col).agg(Summarizer.mean(F.col("_vector")).alias("_mean"))
    return pooled.select(id_col, vector_to_array("_mean").alias(vector_col))
