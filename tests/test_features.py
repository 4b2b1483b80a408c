import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwork.operators import features
from siftwork.operators.embeddings import embed_texts
from siftwork.plans.triage import compute_features
from siftwork.specs import (
    CustomFeature,
    EmbeddingFeature,
    KeywordFeature,
    TfidfFeature,
    check_specs,
    feature_columns,
    spec_from_json,
    spec_to_json,
)
from tests.conftest import YARD, occurrences, values

TEST = KeywordFeature("test", keywords=("it's", "kettle"))
COUNTS = occurrences("it's", "kettle")


def text_length(text):
    return F.length(text)


def test_features_in_spec_order_and_weights(yard):
    specs = [
        CustomFeature("size", weight=2.0, builder=text_length),
        KeywordFeature("kw", weight=3.0, keywords=("kettle",)),
    ]
    rows = features.featurize(yard, specs)
    assert rows.columns == ["doc_id", "text", "_size", "_kw"]
    sixth = rows.where("doc_id = 6").first()
    assert sixth._kw == 2 * 3.0 * 3.0  # keyword weights enter twice
    assert sixth._size == 2.0 * len(sixth.text)
    alone = yard.where("doc_id = 6").select(features.keyword_feature(specs[1]).alias("k")).first()
    assert alone.k == 6.0


def test_featurizing_again_replaces_columns(yard):
    rows = features.featurize(features.featurize(yard, [TEST]), [TEST])
    assert rows.columns == ["doc_id", "text", "_test"]


def test_l1_norm(yard):
    got = values(features.featurize(yard, [TEST], normalize=True), "_test")
    assert got == pytest.approx([n / sum(COUNTS) for n in COUNTS])


def test_l1_norm_by_reference(yard):
    part = yard.where("doc_id in (5, 6)")
    whole = features.featurize(yard, [TEST])
    got = values(features.featurize(part, [TEST], normalize=True, reference=whole), "_test")
    assert got == pytest.approx([0, COUNTS[6] / sum(COUNTS)])


def test_l1_norm_of_zeros(yard):
    nothing = KeywordFeature("none", keywords=("brontide",))
    assert set(values(features.featurize(yard, [nothing], normalize=True), "_none")) == {0.0}


def test_row_cap(yard):
    specs = [KeywordFeature("tick", keywords=("tick",)), KeywordFeature("ick", keywords=("ick", "c"))]
    rows = features.featurize(yard, specs)
    alone = features.row_cap_normalize(rows, ["_tick"]).where("doc_id = 4").first()
    assert alone._tick == 1.0
    both = features.row_cap_normalize(rows, ["_tick", "_ick"]).where("doc_id = 4").first()
    assert both._tick + both._ick == pytest.approx(1.0)
    assert both._tick < both._ick


def test_rename_and_drop(yard):
    rows = features.featurize(yard, [TEST])
    assert "_other" in features.rename_feature(rows, "test", "other").columns
    with pytest.raises(ValueError):
        features.rename_feature(rows, "test", "test")
    assert features.drop_feature(rows, "test").columns == ["doc_id", "text"]


def test_bad_specs():
    with pytest.raises(ValueError):
        check_specs([TEST, TEST])
    with pytest.raises(ValueError):
        check_specs([KeywordFeature("label")])
    with pytest.raises(ValueError):
        check_specs([KeywordFeature("x", weight=6.0)])


def test_feature_columns():
    hidden = KeywordFeature("hidden", in_model=False)
    assert feature_columns([TEST, hidden]) == ["_test", "_hidden"]
    assert feature_columns([TEST, hidden], in_model_only=True) == ["_test"]


@pytest.mark.parametrize(
    "spec",
    [
        TEST,
        TfidfFeature("t", weight=0.5, references=("a", "b")),
        EmbeddingFeature("e", reference=(0.5, 1.0), in_model=False),
        CustomFeature("c", builder="tests.test_features:text_length", columns=("n",), references=("r",)),
    ],
)
def test_spec_json(spec):
    assert spec_from_json(spec_to_json(spec)) == spec


def test_custom_builder_is_saved_by_address():
    saved = spec_from_json(spec_to_json(CustomFeature("c", builder=text_length)))
    assert saved.builder == "tests.test_features:text_length"
    with pytest.raises(ValueError):
        spec_to_json(CustomFeature("c", builder=lambda text: text))


def per_column(text, doc_id, references=()):
    return F.length(text) * 100 + doc_id + len(references)


def test_builder_with_columns_and_references(yard):
    spec = CustomFeature("own", builder=per_column, columns=("doc_id",), references=("a", "b"))
    got = values(features.featurize(yard, [spec]), "_own")
    assert got == [len(t) * 100 + i + 2 for i, t in enumerate(YARD)]
    narrow = compute_features(yard.withColumn("more", F.col("doc_id") * 2), [
        CustomFeature("own", builder=per_column, columns=("more",))
    ])
    assert narrow.columns == ["doc_id", "_own"]
    assert values(narrow, "_own") == [len(t) * 100 + 2 * i for i, t in enumerate(YARD)]


def test_vectorised_python_builder(yard):
    @F.pandas_udf("double")
    def shout(texts: pd.Series) -> pd.Series:
        return texts.str.count("[A-Z]").astype(float)

    spec = CustomFeature("shout", weight=0.5, builder=lambda text: shout(text))
    got = values(features.featurize(yard, [spec, TEST]), "_shout")
    assert got == [0.5 * sum(c.isascii() and c.isupper() for c in t) for t in values(yard, "text")]


def test_many_keywords(yard):
    """Hundreds of keywords are still one projection."""
    many = KeywordFeature("many", keywords=tuple(f"k{i}" for i in range(300)) + ("kettle",))
    assert sum(values(features.featurize(yard, [many, TEST]), "_many")) == 2  # one text names two


def test_embedding_feature(spark, yard):
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [3.0, 3.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])],
        "doc_id bigint, embedding array<float>",
    )
    spec = EmbeddingFeature("e", weight=2.0, reference=(2.0, 0.0))
    got = values(features.featurize(yard, [spec], embeddings=vectors), "_e")
    assert got[0] == pytest.approx(2.0)
    assert got[1] == pytest.approx(2 * (2 / 2**0.5 - 1))
    assert got[2:] == [0.0] * (len(YARD) - 2)
    with pytest.raises(ValueError):
        features.featurize(yard, [spec])


def test_narrow_features_do_not_shuffle_text(yard, tmp_path):
    path = str(tmp_path / "yard")
    yard.write.parquet(path)
    corpus = yard.sparkSession.read.parquet(path)
    specs = [TEST, TfidfFeature("like", references=("a lantern",))]
    rows = features.featurize(corpus, specs).select("doc_id", "_test", "_like")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "text" not in line
    assert rows.count() == len(YARD)


def test_null_and_empty_texts_have_no_features(spark):
    rows = [(1, None), (2, ""), (3, "a kettle in space")]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")

    def load():
        return lambda batch: [[float(len(text)), 1.0] for text in batch]

    vectors = embed_texts(corpus, load)
    specs = [
        TEST,
        TfidfFeature("like", references=("space kettle",)),
        EmbeddingFeature("near", reference=(17.0, 1.0)),
    ]
    got = features.featurize(corpus, specs, embeddings=vectors).orderBy("doc_id").collect()
    assert [tuple(r)[2:4] for r in got[:2]] == [(0.0, 0.0)] * 2
    assert got[0]._near == 0.0
    assert got[2][2:] == (1.0, pytest.approx(1.0), pytest.approx(1.0))


def test_many_keywords_in_one_pass_equal_single_counts(spark, yard, monkeypatch):
    odd = spark.createDataFrame([(50, None), (51, ""), (52, "aaaaa ÉÉ aa\naaa"), (53, "Straße STRASSE")], "doc_id int, text string")
    rows = yard.unionByName(odd)
    specs = [
        KeywordFeature("a", weight=2.0, keywords=("aa", "a", "AA", "", "  ", "é")),
        CustomFeature("size", builder=text_length),
        KeywordFeature("b", weight=0.5, keywords=("it's", "kettle", "aaa", "ss", "lantern and", "n")),
        KeywordFeature("none"),
    ]
    want = sorted(features.featurize(rows, specs).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(features, "SINGLE_KEYWORDS", 0)
    got = sorted(features.featurize(rows, specs).collect(), key=lambda r: r.doc_id)
    assert got == want
