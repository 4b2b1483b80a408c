import random

import pytest

from siftwork.operators import labels
from tests.conftest import YARD

EVENTS = "seq bigint, doc_id bigint, text string, label int"


def ledger(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def state(df):
    return {(r.doc_id, r.text): r.label for r in df.collect()}


def brute_training(rows):
    """Replays events one by one."""
    kept = {}
    for _, doc_id, text, label in sorted(rows):
        if label == -1:
            kept = {key: y for key, y in kept.items() if key[0] != doc_id}
        else:
            kept[doc_id, text] = label
    return kept


def test_relabel_overwrites_and_other_text_appends(spark):
    rows = [(1, 1, "a", 0), (2, 2, "b", 0), (3, 1, "a", 1), (4, 2, "other", 1)]
    assert state(labels.training_set(ledger(spark, rows))) == {
        (1, "a"): 1,
        (2, "b"): 0,
        (2, "other"): 1,
    }


def test_unlabel_removes_every_text_of_an_id(spark):
    rows = [(1, 1, "a", 0), (2, 1, "b", 1), (3, 2, "c", 1), (4, 1, "b", -1), (5, 9, "x", -1)]
    assert state(labels.training_set(ledger(spark, rows))) == {(2, "c"): 1}
    again = rows + [(6, 1, "a", 1)]
    assert state(labels.training_set(ledger(spark, again))) == {(1, "a"): 1, (2, "c"): 1}


@pytest.mark.parametrize("seed", range(3))
def test_training_set_is_a_replay(spark, seed):
    chance = random.Random(seed)
    rows = [
        (seq, chance.randrange(5), chance.choice("abc"), chance.choice([-1, 0, 1]))
        for seq in range(60)
    ]
    want = brute_training(rows)
    chance.shuffle(rows)
    events = ledger(spark, rows)
    assert state(labels.training_set(events)) == want
    compacted = labels.compact_events(events)
    assert state(labels.training_set(compacted)) == want
    latest = {d: y for _, d, _, y in sorted(rows)}
    for ledger_rows in (events, compacted):
        got = {r.doc_id: r.label for r in labels.current_labels(ledger_rows).collect()}
        assert got == latest


def test_apply_labels(spark, yard):
    rows = [(1, 3, "", 1), (2, 4, "", 0), (3, 3, "", 0), (4, 5, "", 1), (5, 5, "", -1)]
    rows += [(6, 99, "", 1)]
    got = {r.doc_id: r._label for r in labels.apply_labels(yard, ledger(spark, rows)).collect()}
    assert got == {i: {3: 0, 4: 0}.get(i, -1) for i in range(len(YARD))}


def test_bulk_lists_in_order(spark):
    batches = spark.createDataFrame(
        [(0, [1, 2, 1], [0, 1, 1]), (10, [2], [-1])],
        "seq bigint, ids array<bigint>, labels array<int>",
    )
    current = labels.current_labels(labels.bulk_events(batches))
    assert {r.doc_id: r.label for r in current.collect()} == {1: 1, 2: -1}


def test_label_all(yard):
    events = labels.label_all(yard.where("doc_id < 3"), 1, seq=7)
    assert sorted((r.seq, r.doc_id, r.label) for r in events.collect()) == [
        (7, 0, 1),
        (7, 1, 1),
        (7, 2, 1),
    ]


def test_rows_for_training(spark, yard):
    events = ledger(spark, [(1, 3, "", 1), (2, 4, "", 0), (3, 4, "", -1)])
    rows = labels.rows_for_training(yard, events).collect()
    assert [(r.doc_id, r._label) for r in rows] == [(3, 1)]


def test_no_text_in_an_aggregation(spark):
    events = ledger(spark, [(1, 1, "a", 0), (2, 2, "b", 1)])
    for frame in (labels.training_set(events), labels.compact_events(events)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and "max_by" not in plan
