"""Feature columns: computing, renaming, dropping and normalising them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.numeric import cosine, row_capped, similarity_activation, vector_literal
from siftwork.functions.text import keyword_count, keyword_counts
from siftwork.operators.textindex import TextIndex
from siftwork.operators.tfidf import IdfTable, fit_idf, keys_of, similarities, stored_counts
from siftwork.specs import (
    CustomFeature,
    EmbeddingFeature,
    Feature,
    KeywordFeature,
    TfidfFeature,
    check_specs,
    feature_columns,
)

#: Features with more keywords than this, taken together, are counted in one pass by an automaton.
SINGLE_KEYWORDS = 64


def keyword_feature(spec: KeywordFeature, text_col: str = "text") -> Column:
    """The keyword feature on its own: count x weight."""
    return keyword_count(text_col, spec.keywords, spec.weight)


def _row_feature(spec: Feature, text_col: str) -> Column:
    """A feature that needs nothing but its row.

    Keyword features get their weight twice, once in the count and once more with all other
    features; this is what scores trained on them expect.
    """
    if isinstance(spec, KeywordFeature):
        return keyword_feature(spec, text_col) * F.lit(float(spec.weight))
    return spec.build(text_col).cast("double") * F.lit(float(spec.weight))


def _with_row_features(
    corpus: DataFrame, kept: Sequence[Column], specs: Sequence[Feature], text_col: str
) -> DataFrame:
    """The kept columns and the row features, keyword features of many keywords by one automaton."""
    listed = [s for s in specs if isinstance(s, KeywordFeature)]
    if sum(len(s.keywords) for s in listed) <= SINGLE_KEYWORDS:
        return corpus.select(*kept, *[_row_feature(s, text_col).alias(s.column) for s in specs])
    others = [_row_feature(s, text_col).alias(s.column) for s in specs if s not in listed]
    counts = keyword_counts(text_col, [s.keywords for s in listed]).alias("_counts")
    counted = corpus.select(*kept, *others, counts)
    weighted = [
        (F.get("_counts", F.lit(i)) * F.lit(float(s.weight) ** 2)).alias(s.column) for i, s in enumerate(listed)
    ]
    return counted.select("*", *weighted).drop("_counts")


def featurize(
    corpus: DataFrame,
    specs: Sequence[Feature],
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    idf: IdfTable | None = None,
    embeddings: DataFrame | None = None,
    normalize: bool = False,
    reference: DataFrame | None = None,
    norms: DataFrame | None = None,
    counts: DataFrame | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """The corpus with one weighted column per spec, in spec order.

    Keyword and custom features are one projection. TF-IDF features share one similarity pass and
    join by id; embedding features join the table of cached embeddings ``(id, embedding)`` by id.
    Select the columns you need afterwards: the text is then pruned before those joins and only ids
    and numbers are shuffled. ``idf`` is the fitted table to use; without it, one is fitted on this
    corpus; ``counts`` and ``norms`` are its stored term counts and text norms, if any; ``index`` is its
    stored index, which holds all of these. With
    ``normalize``, columns are divided by their sums over ``reference`` or this corpus.
    """
    check_specs(specs)
    keys = keys_of(id_col)
    clashing = set(feature_columns(specs)) & set(corpus.columns)
    kept = [F.col(c) for c in corpus.columns if c not in clashing]
    row_specs = [s for s in specs if isinstance(s, (KeywordFeature, CustomFeature))]
    featured = _with_row_features(corpus, kept, row_specs, text_col)

    tfidf_specs = [s for s in specs if isinstance(s, TfidfFeature)]
    referenced = {s.column: s.references for s in tfidf_specs if s.references}
    if referenced and index is not None:
        featured = featured.join(index.similarities(referenced), keys, "left")
    elif referenced:
        if counts is None:
            stop_words = {"stop_words": idf.stop_words} if idf else {}
            counts = stored_counts(corpus, keys, text_col, **stop_words)
        idf = idf or fit_idf(corpus, text_col, counts=counts)
        found = similarities(counts, idf, referenced, keys, text_col, norms)
        featured = featured.join(found, keys, "left")
    weighted = {
        s.column: F.coalesce(F.col(s.column), F.lit(0.0)) * F.lit(float(s.weight))
        if s.references
        else F.lit(0.0)
        for s in tfidf_specs
    }

    embedding_specs = [s for s in specs if isinstance(s, EmbeddingFeature)]
    if embedding_specs:
        if embeddings is None:
            raise ValueError("embedding features need a table of cached embeddings")
        embedded_keys = [key for key in keys if key in embeddings.columns]
        found = embeddings.select(
            *embedded_keys,
            *[
                similarity_activation(
                    cosine(F.col("embedding"), vector_literal(s.reference)), s.floor
                ).alias(s.column)
                for s in embedding_specs
            ],
        )
        featured = featured.join(found, embedded_keys, "left")
    for s in embedding_specs:
        weighted[s.column] = F.coalesce(F.col(s.column), F.lit(0.0)) * F.lit(float(s.weight))

    columns = feature_columns(specs)
    result = featured.select(
        *[c for c in corpus.columns if c not in clashing],
        *[weighted.get(c, F.col(c)).alias(c) for c in columns],
    )
    return l1_normalize(result, columns, reference) if normalize else result


def l1_normalize(
    df: DataFrame, features: Sequence[str], reference: DataFrame | None = None
) -> DataFrame:
    """Divide each feature by its sum over the reference table, by default the table itself.

    The sums are one row, fetched first, so the division is a plain projection. Columns that sum to 0
    become 0. Give it stored features, or they are computed once for the sums and once more here.
    """
    source = df if reference is None else reference
    sums = source.agg(*[F.sum(c).alias(c) for c in features]).first()
    return df.withColumns(
        {c: F.col(c) / F.lit(float(sums[c])) if sums[c] else F.lit(0.0) for c in features}
    )


def row_cap_normalize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale a row's features to sum to 1 where their sum is above 1."""
    return df.withColumns(row_capped(features))


def rename_feature(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a feature column; refused when the new column exists."""
    if f"_{new}" in df.columns:
        raise ValueError(f"another feature is named {new}")
    return df.withColumnRenamed(f"_{old}", f"_{new}")


def drop_feature(df: DataFrame, name: str) -> DataFrame:
    return df.drop(f"_{name}")


def feature_value_counts(df: DataFrame, feature: str) -> DataFrame:
    """How often each value of a feature occurs."""
    return df.groupBy(feature).agg(F.count(F.lit(1)).alias("n"))
