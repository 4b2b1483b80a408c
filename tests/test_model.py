import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import classifier, explore, features
from siftwork.plans import triage as plan
from siftwork.specs import KeywordFeature, TfidfFeature
from tests.conftest import YARD, values

SPECS = [
    KeywordFeature("test", keywords=("it's", "ladder")),
    KeywordFeature("vowels", weight=0.5, keywords=("a", "e")),
]


@pytest.mark.parametrize("negative", [0, 1, 6, 9, 20])
@pytest.mark.parametrize("positive", [0, 1, 4])
@pytest.mark.parametrize("unlabelled", [0, 5])
def test_seed_rule(spark, negative, positive, unlabelled):
    """Ten labels, of both classes."""
    labels = [0] * negative + [1] * positive + [-1] * unlabelled
    rows = spark.createDataFrame([(y,) for y in labels], "_label int")
    count = negative + positive
    assert classifier.is_seeded(rows) is (count >= 10 and negative > 0 and positive > 0)
    status = classifier.seed_status(rows).first()
    assert (status.labelled, status.remaining) == (count, max(10 - count, 0))
    assert status.needs_interesting == (positive == 0)
    assert status.needs_uninteresting == (negative == 0)


POSITIVE = (2, 3, 8)


def usual_events(spark, n=11):
    rows = [(i, i, 1 if i in POSITIVE else 0) for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, doc_id bigint, label int")


def newton(x, y):
    """Class-balanced logistic regression with C = 1 by Newton's method."""
    design = np.hstack([np.ones((len(x), 1)), x])
    n1 = y.sum()
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1)))
    penalty = np.eye(design.shape[1])
    penalty[0, 0] = 0
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weight * (p - y)) + penalty @ beta
        hessian = (design.T * (weight * p * (1 - p))) @ design + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_fit_matches_newton(spark, yard):
    result = plan.triage(yard, SPECS, usual_events(spark))
    rows = result.features.orderBy("doc_id").toPandas()
    x = rows[["_test", "_vowels"]].to_numpy()
    y = np.array([1.0 if i in POSITIVE else 0.0 for i in range(11)])
    beta = newton(x[:11], y)
    assert result.model.intercept == pytest.approx(beta[0], abs=1e-5)
    assert result.model.coefficients == pytest.approx(beta[1:], abs=1e-5)
    predicted = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    assert values(result.scored, "_pred") == pytest.approx(predicted, abs=1e-5)


def test_scored_rows_carry_their_labels(spark, yard):
    result = plan.triage(yard, SPECS, usual_events(spark))
    want = [1 if i in POSITIVE else 0 if i < 11 else -1 for i in range(len(YARD))]
    assert values(result.scored, "_label") == want
    tab = explore.tab(result.scored, "Labeled")
    assert sorted(r.doc_id for r in tab.collect()) == list(range(11))
    gone = spark.createDataFrame([(99, 8, -1)], "seq bigint, doc_id bigint, label int")
    after = plan.relabel(result.features, SPECS, usual_events(spark).unionByName(gone))
    assert values(after.scored, "_label")[8] == -1 and after.model is not None


def test_events_with_texts_are_trained_on_as_they_are(spark, yard):
    """Rows of other texts and other corpora count; corpus rows alone carry labels."""
    rows = [(i, i, YARD[i], 1 if i in POSITIVE else 0) for i in range(6)]
    rows += [(50 + i, 500 + i, f"it's row {i} of another ladder " * i, i % 2) for i in range(6)]
    events = spark.createDataFrame(rows, "seq bigint, doc_id bigint, text string, label int")
    result = plan.triage(yard, SPECS, events)
    training = events.select("doc_id", "text", "label")
    assert result.model.coefficients == pytest.approx(plan.retrain_on(training, SPECS).coefficients)
    assert values(result.scored, "_label") == [r[3] for r in rows[:6]] + [-1] * (len(YARD) - 6)


def test_new_texts_need_the_fitted_idf(spark, yard, gapped):
    specs = [SPECS[0], TfidfFeature("like", references=("moved ladder",))]
    result = plan.triage(yard, specs, usual_events(spark))
    training = yard.withColumn("label", F.lit(1))
    with pytest.raises(ValueError, match="idf"):
        plan.score_new(gapped, specs, result.model)
    with pytest.raises(ValueError, match="idf"):
        plan.retrain_on(training, specs)
    plain = [SPECS[0], TfidfFeature("none")]
    assert plan.score_new(gapped, plain, None).count() == len(YARD) - 3


def test_class_weights(spark):
    rows = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9 + [(-1,)], "_label int")
    got = {r.label: (r.n, r.weight) for r in classifier.class_weights(rows).collect()}
    assert got == {1: (3, 2.0), 0: (9, pytest.approx(12 / 18))}


def test_too_few_labels_leave_no_score(spark, yard):
    result = plan.triage(yard, SPECS, usual_events(spark, 9))
    assert result.model is None and "_pred" not in result.scored.columns
    again = plan.relabel(result.features, SPECS, usual_events(spark, 10))
    assert "_pred" in again.scored.columns
    undone = plan.relabel(again.scored, SPECS, usual_events(spark, 9))
    assert "_pred" not in undone.scored.columns


def test_features_outside_the_model(spark, yard):
    hidden = [SPECS[0], KeywordFeature("vowels", keywords=("a",), in_model=False)]
    result = plan.triage(yard, hidden, usual_events(spark))
    assert result.model.features == ("_test",)
    assert result.columns == ["_test", "_vowels"]
    unused = [KeywordFeature("only", keywords=("a",), in_model=False)]
    assert plan.triage(yard, unused, usual_events(spark)).model is None


def test_training_set_with_its_own_texts_scores_another_corpus(spark, yard, gapped):
    specs = [SPECS[0], TfidfFeature("like", references=("moved ladder",))]
    result = plan.triage(yard, specs, usual_events(spark))
    texts = {r.doc_id: r.text for r in yard.collect()}
    rows = [(i, texts[i], 1 if i in POSITIVE else 0) for i in range(11)]
    training = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = plan.retrain_on(training, specs, idf=result.idf)
    assert model.coefficients == pytest.approx(result.model.coefficients, abs=1e-6)
    scored = plan.score_new(gapped, specs, model, idf=result.idf)
    assert values(scored, "_pred") == pytest.approx(values(result.scored, "_pred")[3:], abs=1e-6)
    assert "_pred" not in gapped.columns


def test_chain_filter(yard):
    rows = features.featurize(yard, SPECS)
    first = classifier.FittedModel(("_test",), (5.0,), -1.0)
    second = classifier.FittedModel(("_vowels",), (-10.0,), 6.0)
    kept = classifier.chain_filter(rows, [first, second]).collect()
    want = [
        r.doc_id for r in rows.collect() if 5 * r._test - 1 > 0 and -10 * r._vowels + 6 > 0
    ]
    assert sorted(r.doc_id for r in kept) == sorted(want)
