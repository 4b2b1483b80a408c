"""Reference texts of similarity features: resolving entries and naming them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import short_text


def short_references(
    references: DataFrame, corpus: DataFrame, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Rows (ref_id, short): the first id with exactly this text, else the text's beginning.

    Texts meet by hash, so no long text is shuffled. The corpus is reduced to the first id per text
    on the map side before the join, so a text with very many copies is no hot key.
    """
    digest = F.sha2(text_col, 256)
    # Never null, or Spark would add a null filter that hashes every text a second time.
    hashed = references.select(
        "ref_id",
        short_text(text_col).alias("_short"),
        F.coalesce(digest, F.lit("no text")).alias("_hash"),
    )
    keyed = corpus.select(F.coalesce(digest, F.lit("")).alias("_hash"), id_col)
    first_ids = keyed.groupBy("_hash").agg(F.min(id_col).alias("_first"))
    return hashed.join(first_ids, "_hash", "left").select(
        "ref_id",
        F.coalesce(F.col("_first").cast("string"), F.col("_short")).alias("short"),
    )


def resolve_entries(
    entries: DataFrame, corpus: DataFrame, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Rows (ref_id, text) of entries (ref_id, entry): an all-digit entry is a row id, else a text.

    An entry naming an id that is not in the corpus, or that no id can be, fails the query.
    """
    by_id = F.col("entry").rlike(r"^\d+$")
    number = F.expr("try_cast(entry AS bigint)")
    wanted = entries.where(by_id).select("ref_id", "entry", number.alias(id_col))
    known = corpus.select(id_col, text_col, F.lit(True).alias("_known"))
    missing = F.raise_error(F.concat(F.lit("no row with id "), F.col("entry")))
    text = F.when(F.col("_known"), F.col(text_col)).otherwise(missing.cast("string"))
    found = wanted.join(known, id_col, "left").select("ref_id", text.alias(text_col))
    literal = entries.where(~by_id).select("ref_id", F.col("entry").alias(text_col))
    return found.unionByName(literal)


def example_reference(
    corpus: DataFrame, row_id: int, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The text of one row as a reference table (ref_id, text)."""
    return corpus.where(F.col(id_col) == row_id).select(
        F.col(id_col).alias("ref_id"), F.col(text_col)
    )
