"""The search index: literals of patterns, and the same rows as a search through every text."""

import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest

from siftwork.operators import explore, searchindex
from tests.conftest import YARD


@pytest.mark.parametrize(("pattern", "want"), [
    ("lantern", [["lantern"]]),
    ("th(e|in)", [["the"], ["thin"]]),
    ("a(?:b|c)d(e|f)", [["abde"], ["abdf"], ["acde"], ["acdf"]]),
    ("<title>[^<]*ion", [["<title>", "ion"]]),
    ("abcd?ef", [["abc", "ef"]]),
    ("abc+def", [["abc", "def"]]),
    ("abc{2}def", [["ab", "def"]]),
    ("ab(cd)+ef", [["abcd", "ef"]]),
    ("ab(cd)*ef", [["ab", "ef"]]),
    ("ab(c[de])fgh", [["ab", "fgh"]]),
    (r"a\.b\wcd", [["a.b", "cd"]]),
    ("cat|dog", [["cat"], ["dog"]]),
    ("cat|", [["cat"], []]),
    ("[a|b]x(y|z)", [["xy"], ["xz"]]),
    ("x[]a]yz", [["x", "yz"]]),
    ("^cat$", [["cat"]]),
    ("", [[]]),
    ("(?x)a b c", None),
    ("abc(?!d)", None),
    (r"\Qa.b\E", None),
    ("(a|b)(a|b)(a|b)(a|b)(a|b)(a|b)", None),
    ("(abc", None),
])
def test_literals(pattern, want):
    assert searchindex.literals(pattern) == want


def test_patterns_that_say_too_little():
    for pattern in ("", "ab", "a.c", "[abc]+", "cat|d", "(cat)?", "é{3}", ".*"):
        assert searchindex.needed(pattern) is None
    assert searchindex.needed("CAT") == searchindex.needed("cat") == [[ord("c") << 16 | ord("a") << 8 | ord("t")]]


TEXTS = [*YARD, None, "", "ab", "THE KELVIN Kettle", "ſail the ſea", "İtem ıtem", "naïve caféteria", "x\ny\nladder"]
PATTERNS = [
    "ladder", "LANTERN", "th(e|at)", "kettle", "sail", "item", "jam|clock", "t[io]ck", "is?n", "(who|our).*ladder",
    "caf.teria", "é", "[aeiou]{3}", "nothing like it", "x\ny", "notebook.*(clock|ladder)", "", "a", "it's",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module", params=[1 << 14, 4])
def index(rows, request):
    before, searchindex.SEGMENT_ROWS = searchindex.SEGMENT_ROWS, request.param
    try:
        return searchindex.build_search_index(rows)
    finally:
        searchindex.SEGMENT_ROWS = before


@pytest.mark.parametrize("listed", [10_000, 0])
def test_the_same_rows_as_without(rows, index, monkeypatch, listed):
    monkeypatch.setattr(searchindex, "LISTED_CANDIDATES", listed)
    for pattern in PATTERNS:
        want = sorted(r.doc_id for r in explore.search(rows, pattern).collect())
        got = sorted(r.doc_id for r in explore.search(rows, pattern, index=index).collect())
        assert got == want, pattern


def test_candidates_hold_the_literals(rows, index):
    found = {r.doc_id for r in index.candidates("notebook.*ladder").collect()}
    assert found == {i for i, t in enumerate(TEXTS) if t and "notebook" in t and "ladder" in t}
    narrow = rows.select("doc_id")
    got = explore.search(narrow, "ladder", texts=rows, index=index)
    assert got.columns == ["doc_id"] and got.count() == sum("ladder" in (t or "") for t in TEXTS)


def test_many_texts_in_places_and_bitmaps(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["quay", "tide", "lamp", "moss", "fern", "rare" * (rng.random() < 0.01)]) for _ in range(6)) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    index = searchindex.build_search_index(rows)
    kinds = {bytes(r.places[:1]) for r in index.postings.collect()}
    assert kinds == {b"p", b"b"}
    for pattern in ("rare", "quay tide", "lamp.*rare", "moss fern moss"):
        got = sorted(r.doc_id for r in explore.search(rows, pattern, index=index).collect())
        assert got == [i for i, t in enumerate(texts) if re.search(pattern, t)]
    plan = explore.search(rows, "rare", index=index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") <= 1


def test_an_empty_table(spark):
    index = searchindex.build_search_index(spark.createDataFrame([], "doc_id bigint, text string"))
    assert index.candidates("lantern").count() == 0


def test_the_index_of_a_stored_table_is_kept(spark, rows, tmp_path):
    place, folder = str(tmp_path / "rows"), str(tmp_path / "shared")
    rows.write.parquet(place)
    first = searchindex.corpus_search_index(spark, place, folder=folder)
    assert searchindex.corpus_search_index(spark, place, folder=folder) == first
    rows.limit(1).write.mode("append").parquet(place)
    assert searchindex.corpus_search_index(spark, place, folder=folder) != first


def test_segments_end_by_the_bytes_of_their_texts(monkeypatch):
    """A worker holds the trigrams of so much text, however long the texts are."""
    texts = ["ab" * n + f" rare{n}" for n in (40, 3, 60, 200, 1)] + [None, "", "tail"]
    monkeypatch.setattr(searchindex, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["id", "text"])
    rows = list(searchindex.segment_rows("b", 3, 100)(iter([batch])))
    segments = [r.column(3)[-1].as_py() for r in rows]
    assert segments == [[0, 1], [2], [3], [4, 5, 6], [7]]
    rare = {code for row in rows for code in row.column(1).to_pylist()}
    assert searchindex.trigrams("rare200") <= rare
