"""Feature specs: what a user declares; operators turn them into columns."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RESERVED_NAMES = ("label", "pred")
WEIGHT_RANGE = (0.0, 5.0)
SIMILARITY_FLOOR = 0.25


@dataclass(frozen=True)
class Feature:
    """A named, weighted feature; its column is the name behind an underscore."""

    name: str
    weight: float = 1.0
    in_model: bool = True

    @property
    def column(self) -> str:
        return f"_{self.name}"


@dataclass(frozen=True)
class KeywordFeature(Feature):
    """Count of keyword occurrences."""

    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class TfidfFeature(Feature):
    """Cosine similarity to the mean TF-IDF vector of the reference texts."""

    references: tuple[str, ...] = ()


@dataclass(frozen=True)
class EmbeddingFeature(Feature):
    """Stretched cosine similarity of a row's cached embedding to a reference vector."""

    reference: tuple[float, ...] = ()
    floor: float = SIMILARITY_FLOOR


@dataclass(frozen=True)
class CustomFeature(Feature):
    """A user's own column: ``builder`` gets the text column and returns a numeric column.

    ``columns`` names further columns of the table, which it gets behind the text; ``references`` are
    texts of its own, which it gets as a keyword argument where there are any. ``builder`` is a
    function, or its "module:function" address, which is what can be saved.
    """

    builder: Callable[..., Column] | str = ""
    columns: tuple[str, ...] = ()
    references: tuple[str, ...] = ()

    def build(self, text_col: str) -> Column:
        builder = self.builder
        if not callable(builder):
            module, _, function = builder.partition(":")
            builder = getattr(importlib.import_module(module), function)
        extra = {"references": self.references} if self.references else {}
        return builder(F.col(text_col), *[F.col(c) for c in self.columns], **extra)


def columns_read(specs: Iterable[Feature]) -> list[str]:
    """Columns besides the text that custom features read."""
    return [c for spec in specs if isinstance(spec, CustomFeature) for c in spec.columns]


KINDS = {
    "keyword": KeywordFeature,
    "tfidf": TfidfFeature,
    "embedding": EmbeddingFeature,
    "custom": CustomFeature,
}


def check_specs(specs: Sequence[Feature]) -> None:
    """Reject clashing or reserved names and weights out of range."""
    names = [spec.name for spec in specs]
    clashing = {name for name in names if names.count(name) > 1}
    if clashing:
        raise ValueError(f"feature names used more than once: {sorted(clashing)}")
    reserved = set(names) & set(RESERVED_NAMES)
    if reserved:
        raise ValueError(f"reserved feature names: {sorted(reserved)}")
    low, high = WEIGHT_RANGE
    for spec in specs:
        if not low <= spec.weight <= high:
            raise ValueError(f"weight of {spec.name} is outside {low}..{high}")


def feature_columns(specs: Iterable[Feature], in_model_only: bool = False) -> list[str]:
    """Feature column names in spec order, optionally only those the model uses."""
    return [spec.column for spec in specs if spec.in_model or not in_model_only]


def spec_to_json(spec: Feature) -> str:
    kind = next(name for name, cls in KINDS.items() if type(spec) is cls)
    values = {field.name: getattr(spec, field.name) for field in fields(spec)}
    if callable(values.get("builder")):
        builder = values["builder"]
        if "<" in builder.__qualname__:
            raise ValueError(f"{spec.name}: only module-level builders can be saved")
        values["builder"] = f"{builder.__module__}:{builder.__qualname__}"
    return json.dumps({"kind": kind, **values})


def spec_from_json(text: str) -> Feature:
    values = json.loads(text)
    kind = KINDS[values.pop("kind")]
    return kind(**{key: tuple(v) if isinstance(v, list) else v for key, v in values.items()})
