"""Saving and loading a triage session as tables.

Every save writes its tables to a new subfolder and then appends one row to the ``saves`` table. A
save that dies half-way is never listed, and saving a session over the folder it was loaded from does
not touch the tables being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

import siftwork
from siftwork.functions.stopwords import ENGLISH
from siftwork.operators.classifier import FittedModel
from siftwork.operators.explore import DEFAULT_SAMPLE
from siftwork.operators.tfidf import IdfTable
from siftwork.sources.manifest import files_digest, files_of, rows_digest
from siftwork.specs import Feature, spec_from_json, spec_to_json

# Fixed values.
OLDEST_MINOR_OF_MAJOR_0 = 7

SAVES_SCHEMA = (
    "save string, saved_at string, version string, text_col string, id_cols array<string>, "
    "sample_size int, intercept double, n_docs bigint, stop_words array<string>, "
    "tables array<string>, corpus_path string, corpus_files string, corpus_rows string"
)


@dataclass(frozen=True)
class Session:
    """What a session consists of; tables that do not exist are None.

    A corpus that is stored already is named by ``corpus_path``, a Parquet table, and not copied: the
    session keeps its place, a list of its files with sizes and times, and a digest of its ids and texts.
    Loading reads neither where the files are the same; where they are not, the ids and texts have to be.
    A corpus given as ``corpus`` alone is copied.
    """

    specs: tuple[Feature, ...]
    text_col: str = "text"
    id_cols: tuple[str, ...] = ("doc_id",)
    sample_size: int = DEFAULT_SAMPLE
    model: FittedModel | None = None
    idf: IdfTable | None = None
    corpus: DataFrame | None = None
    training: DataFrame | None = None
    sample: DataFrame | None = None
    embeddings: DataFrame | None = None
    norms: DataFrame | None = None
    corpus_path: str | None = None
    version: str = field(default_factory=lambda: siftwork.__version__)


def check_version(saved: str, current: str = siftwork.__version__) -> None:
    """Refuse another major version, and minors of version 0 that are too old."""
    saved_major, saved_minor = (int(part) for part in saved.split(".")[:2])
    major = int(current.split(".")[0])
    too_old = saved_major < 1 and saved_minor < OLDEST_MINOR_OF_MAJOR_0
    if saved_major != major or too_old:
        raise ValueError(f"session of version {saved} does not load in version {current}")


def save_session(spark: SparkSession, session: Session, path: str) -> str:
    """Write the session under the path and return the name of this save."""
    save = uuid4().hex
    model, idf = session.model, session.idf
    tables: dict[str, DataFrame | None] = {
        "corpus": None if session.corpus_path else session.corpus,
        "training": session.training,
        "sample": session.sample,
        "embeddings": session.embeddings,
        "norms": session.norms,
        "idf": idf.terms if idf else None,
        "specs": _numbered(spark, {"spec": ([spec_to_json(s) for s in session.specs], pa.string())}),
        "model": None,
    }
    if model:
        columns = {
            "feature": (model.features, pa.string()),
            "coefficient": (model.coefficients, pa.float64()),
        }
        tables["model"] = _numbered(spark, columns)
    written = {name: table for name, table in tables.items() if table is not None}
    for name, table in written.items():
        table.write.parquet(f"{path}/{save}/{name}")
    files = rows = None
    if session.corpus_path:
        files = files_digest(files_of(spark, session.corpus_path))
        stored = spark.read.parquet(session.corpus_path)
        rows = rows_digest(stored, [*session.id_cols, session.text_col])
    entry = (
        save,
        datetime.now(timezone.utc).isoformat(),
        session.version,
        session.text_col,
        list(session.id_cols),
        session.sample_size,
        model.intercept if model else None,
        idf.n_docs if idf else None,
        list(idf.stop_words if idf else ENGLISH),
        list(written),
        session.corpus_path,
        files,
        rows,
    )
    listed = spark.createDataFrame([entry], SAVES_SCHEMA).coalesce(1)
    listed.write.mode("append").json(f"{path}/saves")
    return save


def load_session(spark: SparkSession, path: str, save: str | None = None) -> Session:
    """Read the latest save under the path, or the named one."""
    saves = spark.read.schema(SAVES_SCHEMA).json(f"{path}/saves")
    if save is not None:
        saves = saves.where(F.col("save") == save)
    meta = saves.orderBy(F.desc("saved_at")).first()
    if meta is None:
        raise ValueError(f"no such session under {path}")
    check_version(meta.version)

    def read(name: str) -> DataFrame | None:
        if name not in meta.tables:
            return None
        return spark.read.parquet(f"{path}/{meta.save}/{name}")

    specs = read("specs").orderBy("position").collect()
    model = None
    if "model" in meta.tables:
        rows = read("model").orderBy("position").collect()
        model = FittedModel(
            tuple(r.feature for r in rows), tuple(r.coefficient for r in rows), meta.intercept
        )
    corpus = read("corpus")
    if meta.corpus_path:
        corpus = spark.read.parquet(meta.corpus_path)
        if not _same_corpus(spark, meta, corpus):
            raise ValueError(f"{meta.corpus_path} is not the corpus that was saved")
    idf = None
    if "idf" in meta.tables:
        idf = IdfTable(read("idf"), meta.n_docs, tuple(meta.stop_words))
    return Session(
        specs=tuple(spec_from_json(r.spec) for r in specs),
        text_col=meta.text_col,
        id_cols=tuple(meta.id_cols),
        sample_size=meta.sample_size,
        model=model,
        idf=idf,
        corpus=corpus,
        training=read("training"),
        sample=read("sample"),
        embeddings=read("embeddings"),
        norms=read("norms"),
        corpus_path=meta.corpus_path,
        version=meta.version,
    )


def _same_corpus(spark: SparkSession, meta: Row, corpus: DataFrame) -> bool:
    """Whether the files are those that were saved, or else their ids and texts."""
    if files_digest(files_of(spark, meta.corpus_path)) == meta.corpus_files:
        return True
    columns = [*meta.id_cols, meta.text_col]
    return set(columns) <= set(corpus.columns) and rows_digest(corpus, columns) == meta.corpus_rows


def _numbered(
    spark: SparkSession, columns: Mapping[str, tuple[Sequence, pa.DataType]]
) -> DataFrame:
    """Short driver-side lists, such as specs or coefficients, as a table in list order."""
    arrays = {name: pa.array(list(values), kind) for name, (values, kind) in columns.items()}
    size = len(next(iter(arrays.values())))
    table = pa.table({"position": pa.array(range(size), pa.int32()), **arrays})
    return spark.createDataFrame(table).coalesce(1)
