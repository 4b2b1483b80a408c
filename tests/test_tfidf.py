import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwork.functions.stopwords import ENGLISH
from siftwork.functions.text import words
from siftwork.operators import references, tfidf
from siftwork.operators.features import featurize
from siftwork.specs import TfidfFeature
from tests.conftest import YARD, values


def brute_force(texts, refs, vocabulary_texts=None):
    """Similarities by plain dictionaries."""

    def terms(text):
        return Counter(w for w in re.findall(r"\w\w+", text.lower()) if w not in ENGLISH)

    fitted = [terms(t) for t in vocabulary_texts or texts]
    df = Counter(w for t in fitted for w in t)
    idf = {w: math.log((1 + len(fitted)) / (1 + n)) + 1 for w, n in df.items()}

    def vector(text):
        raw = {w: n * idf[w] for w, n in terms(text).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    centre = Counter()
    for ref in refs:
        centre.update(vector(ref))
    norm = math.sqrt(sum(x * x for x in centre.values()))
    return [
        sum(x * centre.get(w, 0.0) for w, x in vector(t).items()) / norm if norm else 0.0
        for t in texts
    ]


def feature_values(corpus, *refs, **kwargs):
    spec = TfidfFeature("t", references=refs)
    return values(featurize(corpus, [spec], **kwargs), "_t")


def test_term_counts(yard):
    rows = tfidf.term_counts(yard).where("doc_id = 4").collect()
    assert {r.term: r.tf for r in rows} == {"tick": 4, "clock": 1}


def test_empty_texts_have_no_terms(spark):
    rows = spark.createDataFrame([(1, ""), (2, "a I"), (3, None)], "doc_id int, text string")
    assert tfidf.term_counts(rows).count() == 0


@pytest.mark.parametrize("chosen", [(0,), (3,), (8, 9), (0, 4, 10), (12,)])
def test_similarity_to_references(yard, chosen):
    refs = [YARD[i] for i in chosen]
    got = feature_values(yard, *refs)
    assert got == pytest.approx(brute_force(YARD, refs))
    assert all(got[i] > 0.3 for i in chosen)


def test_no_or_unknown_references(yard):
    assert feature_values(yard) == [0.0] * len(YARD)
    assert feature_values(yard, "brontide quoz") == [0.0] * len(YARD)


def test_new_texts_use_the_fitted_idf(yard, gapped):
    idf = tfidf.fit_idf(yard)
    assert idf.n_docs == len(YARD)
    got = feature_values(gapped, YARD[8], idf=idf)
    assert got == pytest.approx(brute_force(YARD[3:], [YARD[8]], YARD))


def test_idf_from_stored_counts_is_the_same(yard):
    counts = tfidf.stored_counts(yard)
    rows = [sorted(t.terms.collect()) for t in (tfidf.fit_idf(yard), tfidf.fit_idf(yard, counts=counts))]
    assert rows[0] == rows[1]


def test_vectors_have_length_one(yard):
    counts = tfidf.stored_counts(yard)
    length = {}
    for r in tfidf.vectors(counts, tfidf.fit_idf(yard, counts=counts)).collect():
        length[r.doc_id] = length.get(r.doc_id, 0.0) + r.x**2
    assert set(length) == set(range(len(YARD)))
    assert list(length.values()) == pytest.approx([1.0] * len(length))


@pytest.mark.parametrize("stored", [False, True])
def test_several_features_in_one_pass(yard, stored):
    counts = tfidf.stored_counts(yard)
    idf = tfidf.fit_idf(yard, counts=counts)
    norms = tfidf.text_norms(counts, idf) if stored else None
    refs = {"one": [YARD[2]], "two": [YARD[4], YARD[9]], "none": ["brontide"]}
    rows = {r.doc_id: r for r in tfidf.similarities(counts, idf, refs, norms=norms).collect()}
    for name, texts in refs.items():
        got = [rows[i][name] if i in rows else 0.0 for i in range(len(YARD))]
        assert got == pytest.approx(brute_force(YARD, texts))
    spec = TfidfFeature("t", references=(YARD[2],))
    featured = values(featurize(yard, [spec], idf=idf, norms=norms, counts=counts), "_t")
    assert featured == pytest.approx(brute_force(YARD, [YARD[2]]))


def test_short_references(spark, yard):
    refs = tfidf.text_list(spark, ["QUINCE JAM.", "More letters than a name of a reference can show"])
    shown = references.short_references(refs, yard).orderBy("ref_id").collect()
    assert [r.short for r in shown] == ["9", "More letters than a name "]


def test_short_reference_of_copies_is_the_first(spark, yard):
    copies = yard.unionByName(yard.withColumn("doc_id", F.col("doc_id") + 100))
    refs = tfidf.text_list(spark, ["Rain all week."])
    assert references.short_references(refs, copies).first().short == "1"


def test_entries(spark, yard):
    entries = tfidf.text_list(spark, ["11", "a literal text"], "entry")
    rows = references.resolve_entries(entries, yard).orderBy("ref_id").collect()
    assert [(r.ref_id, r.text) for r in rows] == [(0, YARD[11]), (1, "a literal text")]


@pytest.mark.parametrize("entry", ["999", "9" * 25])
def test_an_entry_that_names_no_row_fails(spark, yard, entry):
    entries = tfidf.text_list(spark, [entry], "entry")
    with pytest.raises(Exception, match="no row with id"):
        references.resolve_entries(entries, yard).collect()


def test_a_stored_term_is_one_row_for_many_texts(yard):
    """Blocks meet other tables by term, so a frequent term is not shuffled once per text."""
    counts = tfidf.stored_counts(yard)
    terms = [r.term for r in counts.collect()]
    assert len(terms) == len(set(terms)) and "ladder" in terms
    assert {r.term for r in tfidf.term_counts(yard).collect()} == set(terms)


@pytest.mark.parametrize("size", [1, 1 << 24])
def test_blocks_count_the_words_of_odd_texts(spark, monkeypatch, size):
    monkeypatch.setattr(tfidf, "BLOCK_BYTES", size)
    odd = ["été \U0001d4d0\U0001d4d1 \U0001d4d0 x_ _ 12 1", "", None, "İI ßß ΣΣ", "a\tbb\n\nbb", "a bb"]
    texts = [(i % 5, t) for i, t in enumerate(odd)] + [(None, "bb")]
    rows = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    want = Counter()
    for r in rows.select("doc_id", words("text").alias("w")).collect():
        want.update([(r.doc_id, w, n) for w, n in Counter(r.w or []).items()])
    got = Counter((r.doc_id, r.term, r.tf) for r in tfidf.term_counts(rows, stop_words=()).collect())
    assert got == want and (0, "bb", 1) in got and (4, "bb", 2) in got
