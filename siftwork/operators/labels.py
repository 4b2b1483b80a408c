"""The label ledger: an append-only table of label events ``(seq, id, text, label)``.

Labels are 1 (interesting), 0 (uninteresting) and -1 (unlabelled). ``seq`` orders the events and no
two events of one id share it; the current state is always an aggregation over the ledger, so
replaying it in any order, or twice, gives the same result. Aggregations combine on the map side, so
a row relabelled millions of times is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.sources.corpus import LABEL

UNLABELLED = -1


def bulk_events(batches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Expand rows (seq, ids[], labels[]) of parallel lists into one event per entry.

    Entry i of a list gets seq + i, so a later entry for the same id wins; leave room between the seq
    of two batches.
    """
    pairs = F.arrays_zip(F.col("ids").alias(id_col), F.col("labels").alias("label"))
    exploded = batches.select("seq", F.posexplode(pairs).alias("_at", "_pair"))
    return exploded.select(
        (F.col("seq") + F.col("_at")).alias("seq"),
        F.col(f"_pair.{id_col}").alias(id_col),
        F.col("_pair.label").alias("label"),
    )


def label_all(filtered: DataFrame, label: int, seq: int, id_col: str = "doc_id") -> DataFrame:
    """Events that give every row of a filtered table the same label."""
    return filtered.select(
        F.lit(seq).cast("bigint").alias("seq"), id_col, F.lit(label).cast("int").alias("label")
    )


def current_labels(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The latest label of each id, -1 included."""
    return events.groupBy(id_col).agg(F.max_by("label", "seq").alias("label"))


def apply_labels(corpus: DataFrame, events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The corpus with its label column set from the ledger; events on unknown ids change nothing."""
    current = current_labels(events, id_col).withColumnRenamed("label", "_new_label")
    base = F.col(LABEL) if LABEL in corpus.columns else F.lit(UNLABELLED)
    joined = corpus.join(current, id_col, "left")
    merged = F.coalesce(F.col("_new_label"), base).cast("int")
    return joined.withColumn(LABEL, merged).drop("_new_label")


def training_set(
    events: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The labelled rows: the latest event of each (id, text), where not unlabelled since.

    The same id with another text is another row. Unlabelling an id removes all of its rows,
    whatever their text; later events add rows again. The winners are found on numbers and then
    look up their event, so texts enter no aggregation.
    """
    latest = _latest(events, id_col, text_col)
    removed = (
        events.where(F.col("label") == UNLABELLED)
        .groupBy(id_col)
        .agg(F.max("seq").alias("_removed"))
    )
    kept = latest.join(removed, id_col, "left").where(
        F.col("_removed").isNull() | (F.col("seq") > F.col("_removed"))
    )
    return events.join(kept.select(id_col, "seq"), [id_col, "seq"], "left_semi").select(
        id_col, text_col, F.col("label").cast("int").alias("label"), "seq"
    )


def _latest(events: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows (id, seq) of the latest event per id, text and further grouping columns."""
    hashed = events.select(id_col, "seq", F.sha2(F.col(text_col), 256).alias("_hash"), *more)
    groups = [c for c in hashed.columns if c != "seq"]
    return hashed.groupBy(*groups).agg(F.max("seq").alias("seq"))


def compact_events(
    events: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A shorter ledger with the same current state and training set.

    Keeps the latest event of each (id, text) and each id's latest unlabelling.
    """
    unlabel = (F.col("label") == UNLABELLED).alias("_unlabel")
    kept = _latest(events, id_col, text_col, unlabel).select(id_col, "seq")
    return events.join(kept, [id_col, "seq"], "left_semi").select("seq", id_col, text_col, "label")


def rows_for_training(
    corpus: DataFrame, labels: DataFrame, id_col: str = "doc_id"
) -> DataFrame:
    """Rows of the corpus with their ledger label, labelled ones only."""
    current = current_labels(labels, id_col).where(F.col("label") != UNLABELLED)
    return corpus.drop(LABEL).join(current.withColumnRenamed("label", LABEL), id_col)
