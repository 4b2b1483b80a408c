"""From a corpus, feature specs and labels to a score on every row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.classifier import FittedModel, fit, score
from siftwork.operators.features import featurize
from siftwork.operators.labels import UNLABELLED, apply_labels, training_set
from siftwork.operators.textindex import TextIndex
from siftwork.operators.tfidf import IdfTable, fit_idf, keys_of, stored_counts
from siftwork.sources.corpus import LABEL, PREDICTION
from siftwork.sources.durable import durable
from siftwork.specs import Feature, TfidfFeature, columns_read, feature_columns


@dataclass(frozen=True)
class Triage:
    """Features of the corpus, the model fitted on the labelled rows, and the scored corpus.

    ``scored`` carries the labels of the ledger. ``idf`` is fitted on the corpus and belongs to the
    model: other texts are scored with it, never with one of their own.

    ``features`` is narrow, ids, kept columns and numbers, and is written once. Relabelling reuses
    it: only the fit and the scoring expression change.
    """

    specs: tuple[Feature, ...]
    features: DataFrame
    scored: DataFrame
    model: FittedModel | None
    idf: IdfTable | None

    @property
    def columns(self) -> list[str]:
        return feature_columns(self.specs)


def needs_idf(specs: Sequence[Feature]) -> bool:
    return any(isinstance(s, TfidfFeature) and s.references for s in specs)


def check_idf(specs: Sequence[Feature], idf: IdfTable | None) -> None:
    """Refuse TF-IDF features of new texts without the idf that their model was fitted with."""
    if idf is None and needs_idf(specs):
        raise ValueError("TF-IDF features of new texts need the idf table of the fitted model")


def compute_features(
    corpus: DataFrame,
    specs: Sequence[Feature],
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    idf: IdfTable | None = None,
    embeddings: DataFrame | None = None,
    keep: Sequence[str] = (),
    norms: DataFrame | None = None,
    counts: DataFrame | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """Ids, kept columns and features, without the text, written to the shared folder."""
    wanted = [*keys_of(id_col), *keep]
    source = corpus.select(*dict.fromkeys([*wanted, text_col, *columns_read(specs)]))
    featured = featurize(
        source, specs, id_col, text_col, idf, embeddings, norms=norms, counts=counts, index=index
    )
    return durable(featured.select(*wanted, *feature_columns(specs)), "features")


def train(
    training_features: DataFrame, specs: Sequence[Feature], label_col: str = LABEL
) -> FittedModel | None:
    """Fit on the features in the model. None leaves the corpus unscored: old scores are dropped
    when labels fall below the minimum and also when no feature is left in the model."""
    return fit(training_features, feature_columns(specs, in_model_only=True), label_col)


def triage(
    corpus: DataFrame,
    specs: Sequence[Feature],
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    embeddings: DataFrame | None = None,
    keep: Sequence[str] = (),
    index: TextIndex | None = None,
) -> Triage:
    """Featurise, fit on the ledger's training rows, and score the corpus.

    With the stored index of the corpus its texts are not tokenised; without one they are, once for the
    idf table and all TF-IDF features.
    """
    counts = idf = None
    if needs_idf(specs) and index is not None:
        idf = index.idf
    elif needs_idf(specs):
        counts = stored_counts(corpus, id_col, text_col)
        idf = fit_idf(corpus.select(id_col), text_col, counts=counts)
    features = compute_features(
        corpus, specs, id_col, text_col, idf, embeddings, keep, counts=counts, index=index
    )
    return relabel(features, specs, labels, id_col, idf, text_col, embeddings)


def relabel(
    features: DataFrame,
    specs: Sequence[Feature],
    labels: DataFrame,
    id_col: str = "doc_id",
    idf: IdfTable | None = None,
    text_col: str = "text",
    embeddings: DataFrame | None = None,
) -> Triage:
    """Fit and score again after labels changed; features are not computed again.

    Events that bring their texts are trained on with these, also those of other corpora; otherwise
    the current labels of corpus rows are. Either way the scored rows carry the labels of the ledger,
    and no others.
    """
    labelled = apply_labels(features.drop(LABEL), labels, id_col)
    if text_col in labels.columns:
        training = training_set(labels, id_col, text_col)
        model = retrain_on(training, specs, id_col, text_col, idf, embeddings)
    else:
        model = train(labelled.where(F.col(LABEL) != UNLABELLED), specs)
    return Triage(tuple(specs), features, score(labelled.drop(PREDICTION), model), model, idf)


def retrain_on(
    training: DataFrame,
    specs: Sequence[Feature],
    id_col: str = "doc_id",
    text_col: str = "text",
    idf: IdfTable | None = None,
    embeddings: DataFrame | None = None,
) -> FittedModel | None:
    """Fit on a training set that brings its own texts, such as one kept from another corpus.

    The same id may come with several texts, so rows are told apart by id and text hash.
    """
    check_idf(specs, idf)
    keyed = training.withColumn("_text_hash", F.sha2(F.col(text_col), 256))
    featured = featurize(keyed, specs, [id_col, "_text_hash"], text_col, idf, embeddings)
    return train(featured, specs, "label")


def score_new(
    corpus: DataFrame,
    specs: Sequence[Feature],
    model: FittedModel | None,
    id_col: str | Sequence[str] = "doc_id",
    text_col: str = "text",
    idf: IdfTable | None = None,
    embeddings: DataFrame | None = None,
) -> DataFrame:
    """Features and scores of another corpus, with the fitted model and idf."""
    check_idf(specs, idf)
    featured = featurize(corpus, specs, id_col, text_col, idf, embeddings)
    return score(featured.drop(PREDICTION), model)
