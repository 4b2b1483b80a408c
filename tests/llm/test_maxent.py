import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import maxent
from siftwork.llm.catalog import QUERIES


def words_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return low.split()


def rows_of(frame):
    return frame.selectExpr("doc_id as key", "doc_id % 2 = 0 as flag", "coalesce(text, '') as text")


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = rows_of(docs).where("not flag").select("key", "text")
    table, counts = maxent.gather(training)
    return docs, table, counts, maxent.train(training, counts)


def truth(docs):
    counts = Counter()
    ends = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        counts.update(words_of(r.text))
        ends += 1
    return counts, ends


def test_counts(fitted):
    docs, table, counts, _ = fitted
    want, ends = truth(docs)
    assert {bytes(r.word): r.n for r in table.collect()} == want
    assert counts.tokens == sum(want.values()) + ends and counts.distinct == len(want) + 1


def test_classes_are_a_distribution(fitted):
    _, table, counts, model = fitted
    logs = maxent.log_classes(model.weights, model.bias, np.array([[1, 2, 3, 4], [5, 5, 5, 5]]))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)
    assert 1 < np.abs(model.weights).max() < 100
    words = table.collect()
    data = [bytes(r.word) for r in words]
    single = {b"".join([w]) for w, _ in Counter({bytes(r.word): r.n for r in words}).most_common(0)}
    top = sorted(words, key=lambda r: (-r.n, bytes(r.word)))[: maxent.SINGLES - 1]
    single |= {bytes(r.word) for r in top}
    share = np.zeros(maxent.CLASSES)
    for r, w in zip(words, data):
        if w not in single:
            raw = np.frombuffer(w, dtype=np.uint8)
            own = int(maxent.suffix_class(raw, np.array([0]), np.array([len(raw)]))[0])
            share[own] += (r.n + 0.5) / 10 ** counts.class_share()[own]
    never = 0.5 / 10 ** counts.class_share()[maxent.SINGLES :]
    assert np.allclose(share[maxent.SINGLES :] + never, 1)


@pytest.mark.parametrize("head", [200_000, 50])
def test_scores_by_hand(spark, fitted, odd, monkeypatch, head):
    monkeypatch.setattr(maxent, "HEAD_WORDS", head)
    docs = fitted[0]
    training = rows_of(docs).where("not flag").select("key", "text")
    table, counts = maxent.gather(training)
    model = maxent.Model(counts, fitted[3].weights, fitted[3].bias)
    want, ends = truth(docs)
    total, distinct = sum(want.values()) + ends, len(want) + 1
    texts = {r.key: r.text for r in rows_of(odd).collect()}
    rows = maxent.score(rows_of(odd), table, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = words_of(texts[r.key])
        assert r.train_tokens == total and r.n_tokens == len(words) + 1
        assert r.n_known == sum(want[w] > 0 for w in words) + 1
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in [*(want[w] for w in words), ends])
        assert r.base == pytest.approx(base)
        tokens = maxent.tokens_of(pa.array([texts[r.key]]), counts)
        logs = maxent.log_classes(model.weights, model.bias, tokens.features) / math.log(10)
        value = logs[np.arange(len(tokens.classes)), tokens.classes].sum()
        for w, own in zip([*words, None], tokens.classes):
            if own >= maxent.SINGLES:
                value += math.log10(want[w] + 0.5) - counts.class_share()[own]
        assert r.score == pytest.approx(value, rel=1e-4)


def test_held_out_texts_are_more_likely_than_by_words_alone(spark):
    rows = QUERIES["op3_maxent"](spark, "/root/testdata/sf0.01").collect()
    out = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score < 0 for r in rows)


def test_nothing_to_learn_from(spark, empty, odd):
    none = rows_of(empty).select("key", "text")
    table, counts = maxent.gather(none)
    model = maxent.train(none, counts)
    rows = maxent.score(rows_of(odd), table, model).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert maxent.score(rows_of(empty), table, model).count() == 0
