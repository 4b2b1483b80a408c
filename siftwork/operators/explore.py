"""Exploring a corpus: tabs, search, score range, sorted pages, samples and single items."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.text import (
    combined_regex,
    highlight_keywords_and_search,
    ignore_case,
    label_badge,
    prediction_span,
)
from siftwork.operators.ordering import Order, Ranks, take_slice
from siftwork.operators.searchindex import SearchIndex
from siftwork.sources.corpus import LABEL, PREDICTION
from siftwork.specs import Feature, KeywordFeature

# Fixed values.
DEFAULT_SAMPLE = 100
POSITIONS = 2**60
DEFAULT_PAGE = 10
LARGEST_ID = 2**63 - 1
INTERESTING_COLOR = "#FB8C00"
UNINTERESTING_COLOR = "#2196F3"
UNTRAINED_COLOR = "white"
ID_SEARCH = "ID:"

# The bound of a sample lets through its size plus so many times its square root.
SLACK = 6
# Samples up to this size are listed by the driver.
LISTED_SAMPLE = 10_000
TABS = ("Sample", "Labeled", "Interesting", "Selected")


# Lists of rows


def id_list(spark: SparkSession, ids: Iterable[int | str], id_col: str = "doc_id") -> DataFrame:
    """An ordered list of ids as a local table (pos, id); duplicates stay."""
    values = [int(value) for value in ids]
    return spark.createDataFrame(
        pa.table(
            {
                "pos": pa.array(range(len(values)), pa.int64()),
                id_col: pa.array(values, pa.int64()),
            }
        )
    )


def rows_of(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of an id list with their position, repeated as often as the list repeats them.

    Without a hint: Spark broadcasts the list when its known size is small and shuffles it otherwise.
    """
    return df.join(ids.select("pos", id_col), id_col)


def unknown_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entries of an id list that are not in the table."""
    return ids.join(df.select(id_col), id_col, "left_anti")


def sample_order(id_col: str = "doc_id", seed: int = 0) -> Column:
    """A reproducible random position: the first 60 bits of an md5 over id and seed."""
    digest = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def random_sample(
    df: DataFrame,
    n: int = DEFAULT_SAMPLE,
    seed: int = 0,
    id_col: str = "doc_id",
) -> DataFrame:
    """Exactly n rows without replacement as (pos, id); all rows by id when there are no more.

    The rows are those with the smallest positions. Nearly all have one above a bound that n and the number of
    rows give, and are left out where they are read; a bound that proves too low is raised. Nothing is stored.
    """
    total = df.count()
    if total <= n:
        return df.select(F.col(id_col).cast("bigint").alias("pos"), id_col).orderBy("pos", id_col)
    placed = df.select(sample_order(id_col, seed).alias("pos"), id_col)
    share = max(1, n + SLACK * (n**0.5 + 1)) / total
    while True:
        bound = POSITIONS if share >= 1 else int(POSITIONS * share)
        below = placed.where(F.col("pos") < bound)
        first = below.orderBy("pos", id_col).limit(n)
        if n <= LISTED_SAMPLE:  # n narrow rows, listed on the way
            rows = first.collect()
            if len(rows) == n or bound == POSITIONS:
                return _as_list(df.sparkSession, [(r.pos, r[id_col]) for r in rows], first)
        elif bound == POSITIONS or below.count() >= n:
            return first
        share *= 4


def _as_list(spark: SparkSession, rows: Sequence[tuple], like: DataFrame) -> DataFrame:
    """Rows of the driver as a local table, whose size Spark knows when it plans a join."""
    kinds = [spark.createDataFrame([], like.schema).toArrow().schema.field(i).type for i in range(2)]
    columns = [pa.array([row[i] for row in rows], kinds[i]) for i in range(2)]
    return spark.createDataFrame(pa.table(dict(zip(like.columns, columns))))


def append_to_sample(sample: DataFrame, row_id: int, id_col: str = "doc_id") -> DataFrame:
    """The sample with one more id at its end, unchanged when the id is in it already."""
    end = sample.agg(
        (F.coalesce(F.max("pos"), F.lit(-1)) + 1).cast("bigint").alias("pos"),
        F.coalesce(F.max(F.col(id_col) == row_id), F.lit(False)).alias("present"),
    )
    added = end.where(~F.col("present")).select("pos", F.lit(row_id).cast("bigint").alias(id_col))
    return sample.select("pos", id_col).unionByName(added)


# Filters


def tab(
    df: DataFrame,
    name: str | None = None,
    sample: DataFrame | None = None,
    selected: DataFrame | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Rows of a tab: Sample, Labeled, Interesting, Selected, anything else means all.

    A tab whose list or column is missing is empty and keeps the table's columns.
    """
    lists = {"Sample": sample, "Selected": selected}
    if name in lists:
        ids = lists[name]
        return df.limit(0) if ids is None else rows_of(df, ids, id_col)
    conditions = {
        "Labeled": (LABEL, F.col(LABEL) != -1),
        "Interesting": (PREDICTION, F.col(PREDICTION) > 0.5),
    }
    if name not in conditions:
        return df
    column, condition = conditions[name]
    return df.where(condition) if column in df.columns else df.limit(0)


def search(
    df: DataFrame,
    pattern: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    texts: DataFrame | None = None,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Rows whose text matches a regular expression, ignoring case; "ID:n" finds a row by id.

    With ``texts``, a table (id, text), the rows need no text of their own: matching ids are found
    there, and only ids are joined. A number that no id can be finds nothing. With the ``index`` of the
    texts only those that hold the literals of the pattern are searched.
    """
    if not pattern:
        return df
    tail = pattern[len(ID_SEARCH) :]
    if pattern.startswith(ID_SEARCH) and tail.isdecimal():
        return df.where(F.col(id_col) == int(tail)) if int(tail) <= LARGEST_ID else df.limit(0)
    matches = F.col(text_col).rlike(ignore_case(pattern))
    searched = df if texts is None else texts
    found = searched.where(matches) if index is None else index.search(searched, pattern, lambda t: t.where(matches))
    return found if texts is None else df.join(found.select(id_col), id_col, "left_semi")


def prediction_range(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows with a score between the bounds, both included; all rows when unscored."""
    if PREDICTION not in df.columns:
        return df
    return df.where(F.col(PREDICTION).between(low, high))


def filter_chain(
    df: DataFrame,
    tab_name: str | None = None,
    pattern: str = "",
    low: float = 0.0,
    high: float = 1.0,
    sample: DataFrame | None = None,
    selected: DataFrame | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
    texts: DataFrame | None = None,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Tab, score range and search; the search, which is the costly one, comes last.

    Where the tab or the range leave only some rows, their ids pick the texts to be searched.
    """
    kept = prediction_range(tab(df, tab_name, sample, selected, id_col), low, high)
    narrowed = tab_name in TABS or (PREDICTION in df.columns and (low, high) != (0.0, 1.0))
    if texts is not None and pattern and narrowed:
        texts = texts.join(kept.select(id_col), id_col, "left_semi")
    return search(kept, pattern, text_col, id_col, texts, index)


def feature_active(df: DataFrame, *features: str) -> DataFrame:
    """Rows on which all the given features are above 0."""
    for feature in features:
        df = df.where(F.col(feature) > 0)
    return df


def co_activation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """How many rows have each combination of active features."""
    active = [(F.col(c) > 0).alias(c) for c in features]
    return df.groupBy(*active).agg(F.count(F.lit(1)).alias("n"))


# Pages


def page_order(
    columns: Sequence[str], sort_by: str | None = None, descending: bool = False, id_col: str = "doc_id"
) -> Order:
    """The order of pages: by id or by one column, nulls last either way and ties by id.

    Rows of an id list are in list order unless sorted otherwise.
    """
    listed = "pos" in columns
    if sort_by is None or sort_by == id_col:
        order = [(id_col, descending)]
        if listed:
            order = [("pos", False)] if sort_by is None else [*order, ("pos", False)]
        return order
    return [(sort_by, descending), (id_col, False)] + ([("pos", False)] if listed else [])


def page(
    df: DataFrame,
    number: int = 1,
    size: int | None = DEFAULT_PAGE,
    sort_by: str | None = None,
    descending: bool = False,
    id_col: str = "doc_id",
    ranks: Ranks | None = None,
) -> DataFrame:
    """Page ``number``, counted from 1, of the sorted rows; all rows when size is None.

    ``ranks`` are the stored ranks of the table in this ``page_order``; with them any page reads one or two
    files of keys.
    """
    order = page_order(df.columns, sort_by, descending, id_col)
    offset = 0 if size is None else (number - 1) * size
    return take_slice(df, order, offset, size, ranks=ranks)


def with_texts(
    rows: DataFrame, texts: DataFrame, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """A page of narrow rows with their texts looked up by id.

    One join: Spark broadcasts the page, whose size it knows, and reads the texts where they are.
    """
    return rows.join(texts.select(id_col, text_col), id_col)


def keyword_highlight_regex(specs: Sequence[Feature]) -> str:
    """The regex that marks every keyword of the keyword features."""
    return combined_regex(spec.keywords for spec in specs if type(spec) is KeywordFeature)


def page_items(
    rows: DataFrame,
    specs: Sequence[Feature],
    pattern: str = "",
    sample: DataFrame | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """What a page shows of its rows: (id, text with markup, label badge, whether sampled).

    Give it the page, not the table: highlighting then touches only the rows shown. Texts of a page
    of narrow rows come from ``with_texts``.
    """
    marked = highlight_keywords_and_search(text_col, keyword_highlight_regex(specs), pattern)
    prediction = F.col(PREDICTION) if PREDICTION in rows.columns else None
    label = F.col(LABEL) if LABEL in rows.columns else F.lit(-1)
    in_sample = F.lit(False)
    if sample is not None:
        members = sample.select(F.col(id_col).alias("_member")).distinct()
        rows = rows.join(members, F.col(id_col) == F.col("_member"), "left")
        in_sample = F.col("_member").isNotNull()
    return rows.select(
        id_col,
        prediction_span(marked, prediction).alias(text_col),
        label_badge(label).alias("labeled"),
        in_sample.alias("in_sample"),
    )


def item_view(
    df: DataFrame,
    row_id: int,
    specs: Sequence[Feature],
    pattern: str = "",
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row, found by its id, with highlighted text, prediction and label state."""
    marked = highlight_keywords_and_search(text_col, keyword_highlight_regex(specs), pattern)
    label = F.col(LABEL) if LABEL in df.columns else F.lit(-1)
    shown = [
        F.concat(F.lit(ID_SEARCH), F.col(id_col).cast("string")).alias("title"),
        marked.alias(text_col),
        F.when(label == -1, "Not labeled").otherwise("Labeled").alias("label_text"),
        F.when(label == -1, "")
        .when(label >= 0.5, "orange--text darken-1")
        .otherwise("blue--text darken-1")
        .alias("label_class"),
    ]
    if PREDICTION in df.columns:
        prediction = F.col(PREDICTION)
        shown += [
            F.concat(F.lit("Prediction: "), prediction.cast("string")).alias("prediction_text"),
            F.when(prediction > 0.5, "orange--text darken-1")
            .otherwise("blue--text darken-1")
            .alias("prediction_class"),
        ]
    return df.where(F.col(id_col) == row_id).select(id_col, *shown)


def export_points(
    df: DataFrame,
    sample: DataFrame,
    features: Sequence[str],
    low: float = 0.0,
    high: float = 1.0,
    id_col: str = "doc_id",
) -> DataFrame:
    """Sampled rows in the score range as (pos, id text, color, labeled, weights map)."""
    rows = prediction_range(rows_of(df, sample, id_col), low, high)
    total = sum((F.col(c) for c in features), F.lit(0.0))
    weights = []
    for c in features:
        value = F.when(total > 1.0, F.col(c) / total).otherwise(F.col(c))
        weights += [F.lit(c.removeprefix("_")), value]
    color = F.lit(UNTRAINED_COLOR)
    if PREDICTION in df.columns:
        color = F.when(F.col(PREDICTION) > 0.5, INTERESTING_COLOR).otherwise(UNINTERESTING_COLOR)
    labeled = F.col(LABEL) != -1 if LABEL in df.columns else F.lit(False)
    return rows.select(
        "pos",
        F.col(id_col).cast("string").alias("id"),
        color.alias("color"),
        labeled.alias("labeled"),
        F.create_map(*weights).alias("weights"),
    )
