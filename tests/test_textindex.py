"""The stored text index: the same numbers as without it, growth by parts, and what a similarity reads."""

import time

import pytest
from pyspark.sql import functions as F

from siftwork.operators import textindex, tfidf
from siftwork.operators.features import featurize
from siftwork.plans.triage import triage
from siftwork.specs import TfidfFeature
from tests.conftest import YARD, values
from tests.test_tfidf import brute_force

REFERENCES = {"one": [YARD[2]], "two": [YARD[4], YARD[9]], "none": ["brontide"]}


def similar(index, name, ids=range(len(YARD))):
    rows = {r.doc_id: r for r in index.similarities(REFERENCES).collect()}
    return [rows[i][name] if i in rows else 0.0 for i in ids]


@pytest.fixture(scope="module")
def index(yard):
    return textindex.build_index(yard)


@pytest.mark.parametrize("name", REFERENCES)
def test_similarities(index, name):
    assert similar(index, name) == pytest.approx(brute_force(YARD, REFERENCES[name]))


def test_many_terms_are_met_without_ranges(index, monkeypatch):
    monkeypatch.setattr(textindex, "LOOKUP_TERMS", 1)
    assert similar(index, "two") == pytest.approx(brute_force(YARD, REFERENCES["two"]))


def test_vectors_equal_those_without_an_index(index, yard):
    counts = tfidf.stored_counts(yard)
    want = {(r.doc_id, r.term): r.x for r in tfidf.vectors(counts, tfidf.fit_idf(yard, counts=counts)).collect()}
    got = {(r.doc_id, r.term): r.x for r in index.vectors().collect()}
    assert got == pytest.approx(want)


def test_the_plan_of_vectors_sums_nothing_again(index):
    plan = index.vectors()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    assert plan.count("Exchange hashpartitioning(term") <= 2  # postings and idf meet by term at most once


def test_growing_by_parts_equals_one_index(yard):
    grown = textindex.build_index(yard.where("doc_id < 5"))
    grown = textindex.extend_index(grown, yard.where("doc_id >= 5"))
    assert grown.n_docs == len(YARD) and len(grown.parts) == 2
    assert similar(grown, "two") == pytest.approx(brute_force(YARD, REFERENCES["two"]))
    df = {r.term: r.df for r in grown.terms.collect()}
    assert df == {r.term: r.df for r in tfidf.fit_idf(yard).terms.collect()}


def test_an_earlier_version_stays_readable(spark, yard):
    first = textindex.build_index(yard.where("doc_id < 5"))
    textindex.extend_index(first, yard.where("doc_id >= 5"))
    again = textindex.open_index(spark, first.path, first.version)
    assert again == first and similar(again, "one", range(5)) == pytest.approx(brute_force(YARD[:5], [YARD[2]], YARD[:5]))
    assert textindex.open_index(spark, first.path).n_docs == len(YARD)
    assert textindex.open_index(spark, first.path + "-none") is None


def test_a_stored_corpus_is_indexed_once_and_by_added_files(spark, yard, tmp_path, monkeypatch):
    place, folder = str(tmp_path / "yard"), str(tmp_path / "shared")
    yard.where("doc_id < 8").coalesce(1).write.parquet(place)
    first = textindex.corpus_index(spark, place, folder=folder)
    counted = []
    original = textindex.stored_counts

    def noticed(corpus, *more):
        counted.append(corpus.count())
        return original(corpus, *more)

    monkeypatch.setattr(textindex, "stored_counts", noticed)
    assert textindex.corpus_index(spark, place, folder=folder) == first and not counted
    yard.where("doc_id >= 8").coalesce(1).write.mode("append").parquet(place)
    grown = textindex.corpus_index(spark, place, folder=folder)
    assert counted == [len(YARD) - 8]
    assert similar(grown, "two") == pytest.approx(brute_force(YARD, REFERENCES["two"]))
    time.sleep(1.1)  # a changed file is a new corpus
    yard.where("doc_id < 3").coalesce(1).write.mode("overwrite").parquet(place)
    assert textindex.corpus_index(spark, place, folder=folder).n_docs == 3 and counted[1:] == [3]


def test_a_similarity_reads_the_terms_of_its_references(spark, tmp_path):
    terms = [f"t{i:05d}" for i in range(20000)]
    rows = [(i, " ".join(terms[i * 20 : i * 20 + 20])) for i in range(1000)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = textindex.build_index(corpus, path=str(tmp_path / "index"))
    kept = index.postings.where(textindex.in_ranges("term", ["t00007"]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,t00007)" in plan and "LessThanOrEqual(term,t00007)" in plan
    bounds = [
        (r.low, r.high)
        for r in index.postings.groupBy("_metadata.file_name").agg(F.min("term").alias("low"), F.max("term").alias("high")).collect()
    ]
    assert sum(low <= "t00007" <= high for low, high in bounds) == 1  # files hold ranges of terms
    found = index.similarities({"s": ["t00007 t00008"]}).collect()
    assert [r.doc_id for r in found] == [0]


def test_features_and_triage_by_the_index(index, yard, spark):
    spec = TfidfFeature("like", references=(YARD[2],))
    got = values(featurize(yard, [spec], index=index), "_like")
    assert got == pytest.approx(brute_force(YARD, [YARD[2]]))
    events = spark.createDataFrame([(i, i, i % 2) for i in range(12)], "seq int, doc_id bigint, label int")
    result = triage(yard, [spec], events, index=index)
    assert values(result.features, "_like") == pytest.approx(got) and result.idf.n_docs == len(YARD)


def test_empty_and_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a I"), (4, "moved ladder")], "doc_id bigint, text string")
    index = textindex.build_index(rows)
    assert index.n_docs == 4 and [r.doc_id for r in index.norms.collect()] == [4]
    empty = textindex.build_index(rows.limit(0))
    assert empty.n_docs == 0 and empty.similarities(REFERENCES).count() == 0
