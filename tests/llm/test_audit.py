import re
from itertools import permutations

import pytest

from siftwork.llm import audit

LABELS = "doc_id bigint, quality int, toxic int, lang string"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return set(out + ("E" if copy else ""))


def by_hand(rows, labels):
    """Every order played out on every document."""
    rows = [(key, text or "", part or "") for key, text, part in rows]
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text] = min(key, least.get(text, key))
    docs = [(part, fails(t, k is not None and k > least[t]), k) for k, t, part in rows]
    good = {k for k, quality, _ in labels if quality == 1 and k is not None}
    toxic = {k for k, _, bad in labels if bad == 1 and k is not None}
    out = {}
    for part in {p for p, *_ in docs}:
        own = [(f, k) for p, f, k in docs if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own),
                    sum(k in good for _, k in gone), sum(k in toxic for _, k in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.fixture(scope="module")
def cases(odd_rows):
    rows = [(key, text, lang) for key, text, lang, *_ in odd_rows]
    rows += [(1000 + i, text, "en") for i, (_, text, _) in enumerate(rows[:9])]  # copies under larger ids
    rows += [(None, "one", "en"), (None, "one", None), (0, "one", "fr"), (3, "", "fr"), (3, "", "fr"), (2000, "WORD " * 120, "fr")]
    rows += [(3000 + i, "same text", "hot") for i in range(200)]
    labels = [(key, i % 2, (i // 2) % 2) for i, (key, *_) in enumerate(rows)]
    return rows, labels + [(0, None, None), (0, 1, None), (None, 1, 1), (99999, 1, 1)]


def test_equals_every_order_played_out(spark, cases):
    rows, labels = cases
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, part string, n int")
    marks = spark.createDataFrame([(*r, "x") for r in labels], LABELS)
    want = by_hand(rows, labels)
    assert got(audit.audit(docs.repartition(5), marks)) == want
    assert len(want) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark, empty, cases):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(empty, none).count() == 0
    docs = spark.createDataFrame(cases[0], "doc_id bigint, text string, lang string")
    assert got(audit.audit(docs, none)) == by_hand(cases[0], [])


def test_other_filters(spark):
    rows = [(1, "a b"), (2, "a b"), (3, "x"), (4, "")]
    docs = spark.createDataFrame(rows, "id int, body string").selectExpr("*", "'p' AS shelf")
    marks = spark.createDataFrame([(1, 1, 0)], "id int, quality int, toxic int")
    filters = (audit.Filter("S", "size(w) < 2"), audit.Filter("X", "t like '%x%'"))
    found = got(audit.audit(docs, marks, filters, key="id", text="body", part="shelf"))
    assert found["p", "SX", 1] == (2, 2, 0, 1, 0, 0, 3) and found["p", "SX", 2] == (2, 0, 1, 0, 0, 0, 1)
    assert found["p", "XS", 1] == (3, 1, 0, 0, 0, 0, 1) and found["p", "XS", 2] == (2, 1, 1, 1, 0, 0, 3)
