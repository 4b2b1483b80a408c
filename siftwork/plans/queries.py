"""One query per operator over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.text import highlight, keyword_count, tokenize
from siftwork.operators import classifier, embeddings, explore, features, labels, references, stats
from siftwork.operators.classifier import FittedModel
from siftwork.operators.ordering import corpus_ranks
from siftwork.operators.searchindex import corpus_search_index
from siftwork.operators.textindex import TextIndex, corpus_index
from siftwork.operators.tfidf import fit_idf, similarities, stored_counts
from siftwork.plans.triage import (
    compute_features,
    relabel,
    retrain_on,
    score_new,
    train,
    triage,
)
from siftwork.sources.corpus import LABEL, PREDICTION, load_corpus
from siftwork.sources.durable import durable, new_path
from siftwork.sources.session import Session, load_session, save_session
from siftwork.specs import (
    CustomFeature,
    EmbeddingFeature,
    KeywordFeature,
    TfidfFeature,
    feature_columns,
)
from siftwork.streaming.ledger import compact_ledger, read_ledger, write_label_stream
from siftwork.streaming.scoring import score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# What a user of the dashboard would have set up. The texts are invented words, so keywords are
# syllables that occur in them.
THE = KeywordFeature("the", keywords=("the", "The"))
ION = KeywordFeature("ion", weight=2.0, keywords=("ion", "tion"))
CION = KeywordFeature("cion", weight=1.5, keywords=("ción",))
EAU = KeywordFeature("eau", weight=0.5, keywords=("eau", "elle"))
SPECS = (THE, ION, CION, EAU)
COLUMNS = feature_columns(SPECS)
FIT_SPECS = (THE, ION)

# A model as if fitted earlier, so that everything behind a score can be checked exactly.
FIXED_MODEL = FittedModel(tuple(COLUMNS), (0.03, -0.0125, 0.02, -0.04), 0.25)
SECOND_MODEL = FittedModel(("_ion", "_eau"), (0.01, -0.02), -0.2)

# A reference vector of the length of the cached embeddings.
NEAR = tuple(round(((7 * i) % 11 - 5) / 5, 2) for i in range(64))

# A session as a user would save it: keywords, a reference text and a reference vector.
LIKE_TEXT = "Things like erin and thre: the thble, thor and ciónque with leouelle."
SESSION_SPECS = (
    THE,
    TfidfFeature("like", weight=2.0, references=(LIKE_TEXT,)),
    EmbeddingFeature("near", reference=NEAR, floor=0.1),
)
SESSION_MODEL = FittedModel(("_the", "_like", "_near"), (0.02, 1.5, 0.75), -0.5)

SEARCH = "th(e|in)"
RARE_SEARCH = "(copy|all) ?right[^.]*reserved|licen[cs]e"
REFERENCE_TEXT = LIKE_TEXT
SAMPLE_SEED = 7
EXAMPLE_ID = 3
VIEW_ID = 19
SAMPLE_EXTRA_ID = 11
DIGITS = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__.removesuffix("_query")] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream. A pattern may name one file or a folder of files; a plain path only
    a folder."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return load_corpus(spark, f"{folder}/documents.parquet")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and texts only."""
    return documents(spark, folder).select("doc_id", "text")


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """All benchmark passages as reference texts."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("ref_id"), "text")


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return features.featurize(documents(spark, folder), SPECS)


def stored_features(spark: SparkSession, folder: str) -> DataFrame:
    """Narrow features, written once; what filters and reuses feature values starts here."""
    corpus = documents(spark, folder)
    return compute_features(corpus, SPECS, keep=["lang", "source", "n_chars", LABEL])


def sampled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the sampled rows alone, with their position; the sample is joined before the texts
    are worked on."""
    rows = explore.rows_of(documents(spark, folder), sample(spark, folder))
    return compute_features(rows, SPECS, keep=["pos", LABEL])


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.score(stored_features(spark, folder), FIXED_MODEL)


def quality_events(spark: SparkSession, folder: str) -> DataFrame:
    """The labels table as a ledger with one event per row."""
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("seq"), "doc_id", F.col("quality").alias("label")
    )


def changing_events(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger with relabelled and unlabelled rows, and with one id under two texts.

    Toxic rows are labelled 0 later on, when their text has changed; toxic rows of low quality are then
    unlabelled, and toxic rows with an even id labelled 1 once more.
    """
    rows = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "text"), "doc_id"
    )
    toxic = F.col("toxic") == 1
    steps = F.array(
        _event(F.lit(True), 0, F.col("text"), F.col("quality")),
        _event(toxic, 1, F.concat("text", F.lit(" (again)")), F.lit(0)),
        _event(toxic & (F.col("quality") == 0), 2, F.col("text"), F.lit(-1)),
        _event(toxic & (F.col("doc_id") % 2 == 0), 3, F.col("text"), F.lit(1)),
    )
    happened = F.filter(steps, lambda step: step["happens"])
    return rows.select("doc_id", F.inline(happened)).select("seq", "doc_id", "text", "label")


def _event(happens: Column, step: int, text: Column, label: Column) -> Column:
    return F.struct(
        happens.alias("happens"),
        (F.col("doc_id") * 4 + step).alias("seq"),
        text.alias("text"),
        label.cast("int").alias("label"),
    )


def sample(spark: SparkSession, folder: str) -> DataFrame:
    return explore.random_sample(table(spark, folder, "documents"), seed=SAMPLE_SEED)


def selection(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a user selected: all toxic ones, and those of low quality again."""
    rows = table(spark, folder, "labels")
    toxic = rows.where(F.col("toxic") == 1).select((F.col("doc_id") * 2).alias("pos"), "doc_id")
    low = rows.where(F.col("quality") == 0).select((F.col("doc_id") * 2 + 1).alias("pos"), "doc_id")
    return toxic.unionByName(low)


def fitted(spark: SparkSession, folder: str) -> FittedModel | None:
    """A model fitted on the labelled documents."""
    labelled = labels.rows_for_training(documents(spark, folder), quality_events(spark, folder))
    return train(compute_features(labelled, FIT_SPECS, keep=[LABEL]), FIT_SPECS)


# Sources and sinks


@query
def load_corpus_query(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder)


@query
def session_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Save a session with all its parts, load it, and score its training texts with what was loaded;
    the first event of a row stands for its cached vector."""
    path = new_path(spark, "session")
    session = Session(
        specs=SESSION_SPECS,
        model=SESSION_MODEL,
        idf=index_of_documents(spark, folder).idf,
        corpus_path=f"{folder}/documents.parquet",
        training=labels.training_set(changing_events(spark, folder)),
        sample=sample(spark, folder),
        embeddings=_cache(spark, folder),
        sample_size=100,
    )
    save_session(spark, session, path)
    loaded = load_session(spark, path)
    rows = loaded.training.select(F.col("seq").alias("doc_id"), "text")
    own = loaded.embeddings.select((F.col("doc_id") * 4).alias("doc_id"), "embedding")
    rescored = score_new(rows, loaded.specs, loaded.model, idf=loaded.idf, embeddings=own)
    columns = feature_columns(loaded.specs)
    return rounded(rescored.select("doc_id", *columns, PREDICTION), *columns, PREDICTION)


@query
def export_points(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampled_features(spark, folder)
    predicted = classifier.score(rows.drop("pos"), FIXED_MODEL)
    labelled = labels.apply_labels(predicted, quality_events(spark, folder))
    points = explore.export_points(labelled, rows.select("pos", "doc_id"), COLUMNS, 0.2, 0.95)
    weights = [
        F.round(F.col("weights")[c.removeprefix("_")], DIGITS).alias(f"w{c}") for c in COLUMNS
    ]
    return points.select("id", "color", "labeled", *weights)


# Features


@query
def keyword_count_query(spark: SparkSession, folder: str) -> DataFrame:
    counted = [
        keyword_count("text", ["The"]).alias("one"),
        keyword_count("text", ["ion", "tion", "ion"], 2.0).alias("repeated"),
        keyword_count("text", ["", " \n", " of "]).alias("blank"),
        keyword_count("text", ["ción", "é", "Ñ"]).alias("accented"),
    ]
    return texts(spark, folder).select("doc_id", *counted)


@query
def keyword_many(spark: SparkSession, folder: str) -> DataFrame:
    """Two features of several hundred keywords, all words of the passages, counted in one pass."""
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))))
    known = [r.word for r in table(spark, folder, "benchmark").select(found.alias("word")).distinct().collect()]
    early = KeywordFeature("early", keywords=tuple(sorted(w for w in known if w < "m")))
    late = KeywordFeature("late", keywords=tuple(sorted(w for w in known if w >= "m")))
    return features.featurize(texts(spark, folder), [early, THE, late]).drop("text", LABEL)


@query
def featurize_wide(spark: SparkSession, folder: str) -> DataFrame:
    return featured(spark, folder).select("doc_id", "lang", LABEL, *COLUMNS)


@query
def featurize_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Weight once in the feature on its own, twice among all features."""
    alone = features.keyword_feature(ION).alias("alone")
    listed = features.featurize(texts(spark, folder).select("*", alone), [ION])
    return listed.select("doc_id", "alone", F.col("_ion").alias("listed"))


@query
def rename_feature(spark: SparkSession, folder: str) -> DataFrame:
    renamed = features.rename_feature(featured(spark, folder), "ion", "nation")
    return renamed.select("doc_id", "_the", "_nation", "_cion", "_eau")


@query
def drop_feature(spark: SparkSession, folder: str) -> DataFrame:
    return features.drop_feature(featured(spark, folder), "ion").drop("text", "n_chars", LABEL)


def letters_per_word(text: Column) -> Column:
    """A user's own feature: characters per space-separated piece."""
    pieces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.length(text) / pieces


@query
def custom_feature(spark: SparkSession, folder: str) -> DataFrame:
    specs = [CustomFeature("letters", weight=0.5, builder=letters_per_word), THE]
    rows = features.featurize(texts(spark, folder), specs)
    return rounded(rows.select("doc_id", "_letters", "_the"), "_letters")


def words_by_size(text: Column, size: Column, references: Sequence[str]) -> Column:
    """A user's own feature over two columns and texts of its own: how often their words occur, by
    the size that the table holds."""
    known = sorted({word for reference in references for word in reference.split()})
    return keyword_count(text, known) / F.greatest(size, F.lit(1))


@query
def custom_feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    """A custom feature that reads another column and has reference texts, by the stored way."""
    own = CustomFeature(
        "share", builder=words_by_size, columns=("n_chars",), references=("tion erin", "erin chte")
    )
    rows = compute_features(documents(spark, folder), [own, THE])
    return rounded(rows.select("doc_id", "_share", "_the"), "_share", digits=9)


@query
def embedding_feature(spark: SparkSession, folder: str) -> DataFrame:
    """An embedding feature among others; documents without a cached vector have 0."""
    near = EmbeddingFeature("near", weight=2.0, reference=NEAR, floor=0.1)
    rows = compute_features(documents(spark, folder), [THE, near], embeddings=_cache(spark, folder))
    return rounded(rows.select("doc_id", "_the", "_near"), "_near")


@query
def norm_l1(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.l1_normalize(stored_features(spark, folder), COLUMNS)
    return rounded(rows.select("doc_id", *COLUMNS), *COLUMNS, digits=9)


@query
def norm_l1_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows normalised by the sums of the whole corpus."""
    whole = stored_features(spark, folder)
    labelled = labels.rows_for_training(whole, quality_events(spark, folder))
    normed = features.l1_normalize(labelled, COLUMNS, reference=whole)
    return rounded(normed.select("doc_id", *COLUMNS), *COLUMNS, digits=9)


@query
def row_cap_norm(spark: SparkSession, folder: str) -> DataFrame:
    capped = features.row_cap_normalize(featured(spark, folder), COLUMNS)
    return rounded(capped.select("doc_id", *COLUMNS), *COLUMNS)


@query
def feature_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return features.feature_value_counts(featured(spark, folder), "_the")


# Filters


@query
def tab_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = explore.tab(documents(spark, folder), "Sample", sample=sample(spark, folder))
    return rows.select("pos", "doc_id", "lang", "text")


@query
def tab_labeled(spark: SparkSession, folder: str) -> DataFrame:
    labelled = labels.apply_labels(documents(spark, folder), quality_events(spark, folder))
    return explore.tab(labelled, "Labeled").select("doc_id", LABEL, "lang")


@query
def tab_interesting(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        explore.tab(scored(spark, folder), "Interesting").select("doc_id", PREDICTION), PREDICTION
    )


@query
def tab_selected(spark: SparkSession, folder: str) -> DataFrame:
    rows = explore.tab(documents(spark, folder), "Selected", selected=selection(spark, folder))
    return rows.select("pos", "doc_id", "lang", "source")


@query
def search_regex(spark: SparkSession, folder: str) -> DataFrame:
    """By the stored search index: of all texts those that hold the literals of the pattern are read."""
    index = corpus_search_index(spark, f"{folder}/documents.parquet")
    return explore.search(table(spark, folder, "documents"), SEARCH, index=index).select("doc_id", "lang")


@query
def search_rare(spark: SparkSession, folder: str) -> DataFrame:
    """Several literals with something between them; most texts lack one of them."""
    index = corpus_search_index(spark, f"{folder}/documents.parquet")
    return explore.search(table(spark, folder, "documents"), RARE_SEARCH, index=index).select("doc_id", "lang")


@query
def search_without_literals(spark: SparkSession, folder: str) -> DataFrame:
    """A pattern that needs no literal is looked for in every text."""
    index = corpus_search_index(spark, f"{folder}/documents.parquet")
    return explore.search(table(spark, folder, "documents"), "[aeiou]{4}", index=index).select("doc_id", "lang")


@query
def search_markup(spark: SparkSession, folder: str) -> DataFrame:
    """The same search over raw pages."""
    pages = table(spark, folder, "pages")
    found = explore.search(pages, "<title>[^<]*ion", text_col="html", id_col="page_id")
    return found.select("page_id", "url")


@query
def search_id(spark: SparkSession, folder: str) -> DataFrame:
    """An id search looks only among the rows of the tab: the first labelled id is found there, the
    first unlabelled one and a number that is no id are not."""
    events = quality_events(spark, folder)
    inside = events.agg(F.min("doc_id")).first()[0]
    others = documents(spark, folder).join(events, "doc_id", "left_anti")
    outside = others.agg(F.min("doc_id")).first()[0]
    labelled = labels.apply_labels(documents(spark, folder), events)
    found = [
        explore.search(explore.tab(labelled, "Labeled"), f"ID:{value}")
        .select("doc_id", LABEL, "text")
        .withColumn("searched", F.lit(number))
        for number, value in enumerate((inside, outside, "9" * 20))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def tab_without_list(spark: SparkSession, folder: str) -> DataFrame:
    """Tabs whose list or column is missing are empty; all rows stay countable."""
    rows = documents(spark, folder).select("doc_id")
    names = ["Sample", "Selected", "Interesting", "Labeled", "All"]
    found = [explore.tab(rows, name).select(F.lit(name).alias("tab"), "doc_id") for name in names]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    listed = spark.createDataFrame([(name,) for name in names], "tab string")
    return listed.join(every, "tab", "left").groupBy("tab").agg(F.count("doc_id").alias("n"))


@query
def pred_range(spark: SparkSession, folder: str) -> DataFrame:
    kept = explore.prediction_range(scored(spark, folder), 0.3, 0.6)
    return rounded(kept.select("doc_id", PREDICTION), PREDICTION)


@query
def pred_ge_half(spark: SparkSession, folder: str) -> DataFrame:
    kept = scored(spark, folder).where(F.col(PREDICTION) >= 0.5)
    return rounded(kept.select("doc_id", "lang", PREDICTION), PREDICTION)


def _filtered(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels.apply_labels(scored(spark, folder), quality_events(spark, folder))
    corpus = texts(spark, folder)
    return explore.filter_chain(rows, "Labeled", SEARCH, 0.1, 0.9, texts=corpus)


@query
def filter_chain(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_filtered(spark, folder).select("doc_id", LABEL, PREDICTION), PREDICTION)


@query
def filter_chain_count(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder).agg(F.count(F.lit(1)).alias("n"))


@query
def feature_active(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled rows on which a feature is active."""
    rows = sampled_features(spark, folder)
    return explore.feature_active(rows, "_ion").select("pos", "doc_id", "_ion")


@query
def co_activation(spark: SparkSession, folder: str) -> DataFrame:
    return explore.co_activation(featured(spark, folder), COLUMNS)


@query
def chain_filter(spark: SparkSession, folder: str) -> DataFrame:
    kept = classifier.chain_filter(stored_features(spark, folder), [FIXED_MODEL, SECOND_MODEL])
    best = F.greatest("_pred_0", "_pred_1").alias("best")
    return rounded(kept.select("doc_id", "_pred_0", "_pred_1", best), "_pred_0", "_pred_1", "best")


# Labels


@query
def labels_applied(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels.apply_labels(documents(spark, folder), changing_events(spark, folder))
    return rows.select("doc_id", LABEL, "source")


@query
def labels_bulk(spark: SparkSession, folder: str) -> DataFrame:
    """Label lists given per quality class, ids listed twice where toxic; later entries win."""
    entry = F.struct("doc_id", F.col("quality").alias("y"))
    repeat = F.struct("doc_id", (1 - F.col("quality")).alias("y"))
    entries = F.when(F.col("toxic") == 1, F.array(entry, repeat)).otherwise(F.array(entry))
    batches = table(spark, folder, "labels").select(
        (F.col("doc_id") * 4).alias("seq"),
        F.transform(entries, lambda e: e["doc_id"]).alias("ids"),
        F.transform(entries, lambda e: e["y"]).alias("labels"),
    )
    events = labels.bulk_events(batches)
    return labels.apply_labels(documents(spark, folder), events).select("doc_id", LABEL)


@query
def label_all_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Everything a search finds is labelled uninteresting, over earlier labels."""
    corpus = documents(spark, folder)
    found = explore.filter_chain(documents(spark, folder), pattern=SEARCH)
    events = quality_events(spark, folder).select("seq", "doc_id", "label")
    bulk = labels.label_all(found, 0, seq=2**62)
    return labels.apply_labels(corpus, events.unionByName(bulk)).select("doc_id", LABEL)


@query
def training_upsert(spark: SparkSession, folder: str) -> DataFrame:
    events = changing_events(spark, folder).where(F.col("label") != -1)
    return labels.training_set(events)


@query
def training_unlabel(spark: SparkSession, folder: str) -> DataFrame:
    return labels.training_set(changing_events(spark, folder))


@query
def ledger_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Compacting the ledger leaves the training set as it is."""
    return labels.training_set(labels.compact_events(changing_events(spark, folder)))


# Statistics


@query
def coverage_total(spark: SparkSession, folder: str) -> DataFrame:
    covered = stats.coverage(featured(spark, folder), COLUMNS)
    return rounded(covered, "total_pct", "pos_pct", "neg_pct")


@query
def coverage_pos_neg(spark: SparkSession, folder: str) -> DataFrame:
    covered = stats.coverage(scored(spark, folder), COLUMNS)
    return rounded(covered, "total_pct", "pos_pct", "neg_pct")


@query
def coverage_text(spark: SparkSession, folder: str) -> DataFrame:
    return stats.coverage_text(stats.coverage(scored(spark, folder), COLUMNS))


@query
def hist_global(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(scored(spark, folder))


@query
def hist_local(spark: SparkSession, folder: str) -> DataFrame:
    return stats.histogram(classifier.score(sampled_features(spark, folder), FIXED_MODEL))


@query
def hist_unscored(spark: SparkSession, folder: str) -> DataFrame:
    """Without scores all bins are empty."""
    return stats.histogram(stored_features(spark, folder))


@query
def pred_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return stats.predicted_by_category(scored(spark, folder), "lang")


@query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return stats.confusion(scored(spark, folder), F.col("lang") == "en")


# Seeds and class weights


@query
def is_seeded(spark: SparkSession, folder: str) -> DataFrame:
    """The seed rule on the labelled documents: enough labels, and of both classes."""
    rows = labels.rows_for_training(documents(spark, folder), quality_events(spark, folder))
    return classifier.seed_status(rows).select("labelled", "seeded")


@query
def seed_status(spark: SparkSession, folder: str) -> DataFrame:
    """What is missing before a model of toxic rows could be trained."""
    return classifier.seed_status(table(spark, folder, "labels"), "toxic")


@query
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(classifier.class_weights(table(spark, folder, "labels"), "quality"), "weight")


# Sorting, pages, samples, items


@query
def page_sorted_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = explore.page(table(spark, folder, "documents"), 3, sort_by="doc_id", descending=True)
    return rows.select("doc_id", "lang", "text")


@query
def page_sorted_col(spark: SparkSession, folder: str) -> DataFrame:
    rows = explore.page(
        table(spark, folder, "documents"), 2, 25, sort_by="n_chars", descending=True
    )
    return rows.select("doc_id", "n_chars", "source")


@query
def page_deep(spark: SparkSession, folder: str) -> DataFrame:
    """A page down an order with many ties, by stored ranks: one or two files of keys are read."""
    rows = table(spark, folder, "documents").select("doc_id", "source")
    order = explore.page_order(rows.columns, "source")
    ranks = corpus_ranks(spark, f"{folder}/documents.parquet", order)
    return explore.page(rows, 9, 20, sort_by="source", ranks=ranks)


@query
def page_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = labels.apply_labels(scored(spark, folder), quality_events(spark, folder))
    corpus = texts(spark, folder)
    kept = explore.filter_chain(rows, pattern=SEARCH, low=0.05, texts=corpus)
    shown = explore.with_texts(explore.page(kept, 2, 10, sort_by="n_chars"), corpus)
    return explore.page_items(shown, SPECS, SEARCH, sample(spark, folder))


@query
def row_decoration(spark: SparkSession, folder: str) -> DataFrame:
    """The page markup of every row."""
    predicted = classifier.score(featured(spark, folder), FIXED_MODEL)
    rows = labels.apply_labels(predicted, quality_events(spark, folder))
    return explore.page_items(rows, SPECS, "", sample(spark, folder))


@query
def random_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sample(spark, folder)


@query
def sample_append(spark: SparkSession, folder: str) -> DataFrame:
    longer = explore.append_to_sample(sample(spark, folder), SAMPLE_EXTRA_ID)
    return explore.append_to_sample(longer, SAMPLE_EXTRA_ID)


@query
def item_view(spark: SparkSession, folder: str) -> DataFrame:
    predicted = classifier.score(features.featurize(documents(spark, folder), SPECS), FIXED_MODEL)
    rows = labels.apply_labels(predicted, quality_events(spark, folder))
    return explore.item_view(rounded(rows, PREDICTION), VIEW_ID, SPECS, "on")


# Text


@query
def highlight_query(spark: SparkSession, folder: str) -> DataFrame:
    regex = explore.keyword_highlight_regex(SPECS)
    marked = highlight("text", regex).alias("text")
    return texts(spark, folder).select("doc_id", marked)


@query
def highlight_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    """The search pass also marks what the keyword pass wrote."""
    rows = texts(spark, folder)
    shown = explore.page_items(rows, SPECS, "span|ea")
    return shown.select("doc_id", "text")


@query
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    tokens = texts(spark, folder).select("doc_id", tokenize("text").alias("tokens"))
    return tokens.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("tokens")).cast("bigint").alias("n_distinct"),
    )


# TF-IDF and references


def index_of_documents(spark: SparkSession, folder: str) -> TextIndex:
    """The stored index of the documents: built by the first query that asks for it, read by the others."""
    return corpus_index(spark, f"{folder}/documents.parquet")


def _similarity_rows(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    joined = table(spark, folder, "documents").select("doc_id").join(found, "doc_id", "left")
    return joined.select(
        "doc_id", F.round(F.coalesce("similarity", F.lit(0.0)), DIGITS).alias("similarity")
    )


@query
def tfidf_idf(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(index_of_documents(spark, folder).terms, "idf")


@query
def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(index_of_documents(spark, folder).vectors(), "x")


def _similarity(spark: SparkSession, folder: str, reference: DataFrame | Sequence[str]) -> DataFrame:
    found = index_of_documents(spark, folder).similarities({"similarity": reference})
    return _similarity_rows(spark, folder, found)


@query
def tfidf_sim_single(spark: SparkSession, folder: str) -> DataFrame:
    return _similarity(spark, folder, [REFERENCE_TEXT])


@query
def tfidf_sim_multi(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity to the mean of all benchmark passages, without an index: counts and idf are made here."""
    corpus = texts(spark, folder)
    counts = stored_counts(corpus)
    idf = fit_idf(corpus, counts=counts)
    return _similarity_rows(spark, folder, similarities(counts, idf, {"similarity": passages(spark, folder)}))


@query
def tfidf_sim_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the stored index."""
    return _similarity(spark, folder, passages(spark, folder))


@query
def tfidf_feature(spark: SparkSession, folder: str) -> DataFrame:
    """TF-IDF and keyword features side by side, the TF-IDF weight applied once."""
    specs = [THE, TfidfFeature("like", weight=2.0, references=(REFERENCE_TEXT,))]
    specs.append(TfidfFeature("nothing", references=()))
    rows = features.featurize(texts(spark, folder), specs, index=index_of_documents(spark, folder))
    return rounded(rows.select("doc_id", "_the", "_like", "_nothing"), "_like")


@query
def example_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """A new feature whose reference is the text of a row."""
    example = references.example_reference(table(spark, folder, "documents"), EXAMPLE_ID)
    return _similarity(spark, folder, example)


@query
def reference_short(spark: SparkSession, folder: str) -> DataFrame:
    """Names of references: every document's text, and every benchmark passage."""
    own = table(spark, folder, "documents").select(F.col("doc_id").alias("ref_id"), "text")
    others = passages(spark, folder).withColumn("ref_id", -1 - F.col("ref_id"))
    return references.short_references(own.unionByName(others), table(spark, folder, "documents"))


@query
def reference_by_id(spark: SparkSession, folder: str) -> DataFrame:
    """Entries typed by a user: labelled row ids, and literal passages."""
    ids = table(spark, folder, "labels").select(
        F.col("doc_id").alias("ref_id"), F.col("doc_id").cast("string").alias("entry")
    )
    literal = passages(spark, folder).select(
        (-1 - F.col("ref_id")).alias("ref_id"), F.col("text").alias("entry")
    )
    return references.resolve_entries(ids.unionByName(literal), table(spark, folder, "documents"))


# Embeddings


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query
def embedding_sim(spark: SparkSession, folder: str) -> DataFrame:
    cache = _cache(spark, folder)
    reference = cache.where(F.col("doc_id") == 0).select("embedding").scalar()
    found = embeddings.embedding_similarity(cache, reference)
    return rounded(found, "cosine", "feature")


@query
def embed_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return embeddings.missing_from_cache(rows, _cache(spark, folder))


def letter_embedder(more: float = 0.0) -> Callable:
    """A loader of a stand-in for a user's model: it counts five letters, and adds a number to each count.

    The loader is a local function, which travels to the workers by value.
    """

    def load() -> Callable:
        def embed(batch):
            return [[text.count(letter) + more for letter in "aeiou"] for text in batch]

        return embed

    return load


@query
def embed_batch(spark: SparkSession, folder: str) -> DataFrame:
    found = embeddings.embed_texts(texts(spark, folder), letter_embedder())
    letters = [F.get("embedding", i).cast("double").alias(f"n_{c}") for i, c in enumerate("aeiou")]
    return found.select("doc_id", *letters)


@query
def embed_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Cached rows keep their vector; only the others are embedded."""
    corpus = texts(spark, folder)
    whole = embeddings.extend_cache(corpus, _cache(spark, folder), letter_embedder())
    values = whole.select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return rounded(
        values.select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value")),
        "value",
    )


@query
def embed_changed(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of an earlier state of the documents, extended to what they are now.

    Toxic rows had another text then and are embedded again; the other labelled rows keep the vector that the
    cache has, here one letter more than a fresh one.
    """
    corpus = texts(spark, folder)
    marks = table(spark, folder, "labels").select("doc_id", "toxic")
    before = corpus.join(marks, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, F.concat("text", F.lit(" once"))).otherwise(F.col("text")).alias("text")
    )
    early = embeddings.extend_text_cache(before, None, letter_embedder(1.0), "letters")
    other = embeddings.extend_text_cache(corpus, early, letter_embedder(7.0), "another model")
    cache = embeddings.extend_text_cache(corpus, durable(other, "cache"), letter_embedder(), "letters")
    found = embeddings.cached_embeddings(corpus, cache, "letters")
    letters = [F.get("embedding", i).cast("double").alias(f"n_{c}") for i, c in enumerate("aeiou")]
    return found.select("doc_id", *letters)


@query
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    pooled = embeddings.mean_pool(table(spark, folder, "embeddings"), "label")
    values = pooled.select("label", F.posexplode("embedding").alias("dim", "value"))
    return rounded(values.withColumn("dim", F.col("dim").cast("bigint")), "value")


# Model


@query
def score_fixed_coef(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(scored(spark, folder).select("doc_id", PREDICTION), PREDICTION)


@query
def fit_logreg(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(classifier.coefficients(spark, fitted(spark, folder)), "coefficient", digits=5)


@query
def coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients without the intercept, the most telling first."""
    rows = classifier.coefficients(spark, fitted(spark, folder))
    rows = rows.where(F.col("feature") != "(intercept)").orderBy(F.desc(F.abs("coefficient")))
    return rounded(rows, "coefficient", digits=5)


@query
def score_corpus(spark: SparkSession, folder: str) -> DataFrame:
    result = triage(texts(spark, folder), FIT_SPECS, quality_events(spark, folder))
    return rounded(result.scored.select("doc_id", LABEL, PREDICTION), PREDICTION, digits=4)


@query
def labeled_after_triage(spark: SparkSession, folder: str) -> DataFrame:
    """The Labeled tab of what a triage returns."""
    result = triage(texts(spark, folder), FIT_SPECS, quality_events(spark, folder))
    return explore.tab(result.scored, "Labeled").select("doc_id", LABEL)


@query
def score_second_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labels made on the documents, kept with their texts, score the conversations."""
    kept = labels.training_set(changing_events(spark, folder))
    model = retrain_on(kept, FIT_SPECS)
    turns = table(spark, folder, "conversations")
    predicted = score_new(turns, FIT_SPECS, model, ["conv_id", "turn"])
    columns = [*feature_columns(FIT_SPECS), PREDICTION]
    return rounded(predicted.select("conv_id", "turn", *columns), PREDICTION, digits=4)


@query
def score_second_corpus_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations under a model of the documents, with the documents' idf."""
    idf = index_of_documents(spark, folder).idf
    specs = [THE, TfidfFeature("like", weight=2.0, references=(REFERENCE_TEXT,))]
    model = FittedModel(("_the", "_like"), (0.02, 1.5), -0.5)
    turns = table(spark, folder, "conversations")
    predicted = score_new(turns, specs, model, ["conv_id", "turn"], idf=idf)
    return rounded(predicted.select("conv_id", "turn", "_the", "_like", PREDICTION), "_like", PREDICTION)


@query
def untrain_drops_pred(spark: SparkSession, folder: str) -> DataFrame:
    """Unlabelling one class takes the model away, and its scores with it."""
    before = scored(spark, folder)
    events = quality_events(spark, folder)
    undone = events.where(F.col("label") == 0).select(
        (F.col("seq") + 2**40).alias("seq"), "doc_id", F.lit(-1).alias("label")
    )
    after = relabel(before, SPECS, events.unionByName(undone))
    return after.scored.select("doc_id", *[c for c in after.scored.columns if c.startswith("_")])


@query
def retrain_and_score(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way: features, fit on the labels, scores, coverage by predicted class."""
    result = triage(texts(spark, folder), FIT_SPECS, quality_events(spark, folder))
    covered = stats.coverage(result.scored, result.columns)
    return rounded(covered, "total_pct", "pos_pct", "neg_pct", digits=4)


# Streams


@query
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    stream = stream_of(spark, folder, "documents")
    out = new_path(spark, "stream-scores")
    started = (
        score_stream(stream, SPECS, FIXED_MODEL)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return rounded(spark.read.parquet(out), PREDICTION)


def _streamed_ledger(spark: SparkSession, folder: str) -> str:
    """A ledger filled by a stream: labels, and toxic rows unlabelled after."""
    stream = stream_of(spark, folder, "labels")
    steps = F.array(
        F.struct((F.col("doc_id") * 2).alias("seq"), F.col("quality").alias("label")),
        F.struct(
            (F.col("doc_id") * 2 + 1).alias("seq"),
            F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("label"),
        ),
    )
    events = stream.select("doc_id", F.inline(steps)).select(
        "seq", "doc_id", F.concat(F.lit("row "), F.col("doc_id")).alias("text"), "label"
    )
    ledger = new_path(spark, "ledger")
    write_label_stream(events, ledger, new_path(spark, "ledger-state")).awaitTermination()
    return ledger


@query
def stream_labels_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The same after the streamed ledger was compacted."""
    ledger = _streamed_ledger(spark, folder)
    compact_ledger(spark, ledger)
    return labels.training_set(read_ledger(spark, ledger))


@query
def stream_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label events arriving as a stream, then the training state they leave."""
    return labels.training_set(read_ledger(spark, _streamed_ledger(spark, folder)))
