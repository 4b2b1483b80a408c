"""Scoring a stream of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from siftwork.operators.classifier import FittedModel, score
from siftwork.operators.features import featurize
from siftwork.specs import CustomFeature, Feature, KeywordFeature, feature_columns


def score_stream(
    stream: DataFrame,
    specs: Sequence[Feature],
    model: FittedModel,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Features and score of each arriving row. Stateless: a projection without shuffle or watermark.

    Takes features that need only their row; similarity features are joins and belong in a batch.
    """
    for spec in specs:
        if not isinstance(spec, (KeywordFeature, CustomFeature)):
            raise ValueError(f"{spec.name} needs a join; score it in a batch")
    scored = score(featurize(stream, specs, id_col, text_col), model)
    return scored.select(id_col, *feature_columns(specs), "_pred")
