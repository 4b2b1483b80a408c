import random
import re

import pytest
from pyspark.sql import functions as F

from siftwork.operators import explore, features, labels, ordering, stats
from siftwork.specs import KeywordFeature
from tests.conftest import YARD, occurrences, values

SCORES = [round(0.03 + 0.075 * i, 3) for i in range(len(YARD))]
EVERY = list(range(len(YARD)))
ITS = KeywordFeature("its", keywords=("it's",))
TEST = KeywordFeature("test", keywords=("it's", "kettle"))
ITS_COUNTS, TEST_COUNTS = occurrences("it's"), occurrences("it's", "kettle")


@pytest.fixture(scope="module")
def predicted(spark, yard):
    rows = spark.createDataFrame(list(enumerate(SCORES)), "doc_id bigint, _pred double")
    return yard.join(rows, "doc_id")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def by_python(pattern):
    return [i for i, t in enumerate(YARD) if re.search(pattern, t, re.IGNORECASE)]


@pytest.mark.parametrize("pattern", ["clock", "", "e", "LADDER", "^my", r"(ju|j)am\b", "brontide", "éC", "i[dt]"])
def test_search(yard, pattern):
    assert ids(explore.search(yard, pattern)) == by_python(pattern)
    assert ids(explore.search(yard.select("doc_id"), pattern, texts=yard)) == by_python(pattern)


@pytest.mark.parametrize(
    "pattern,found", [("ID:11", [11]), ("ID:007", [7]), ("ID:40", []), ("ID:x", []), ("ID:" + "9" * 22, [])]
)
def test_search_by_id(yard, pattern, found):
    assert ids(explore.search(yard, pattern)) == found
    assert ids(explore.search(yard.select("doc_id"), pattern, texts=yard)) == found


def test_search_behind_a_tab_reads_the_tabs_texts(spark, yard, predicted):
    narrow = predicted.select("doc_id", "_pred")
    sample = explore.id_list(spark, [2, 3, 11, 1])
    for kwargs in ({"tab_name": "Sample", "sample": sample}, {"low": 0.2, "high": 0.5}, {}):
        whole = explore.filter_chain(predicted, pattern="ladder", **kwargs)
        found = explore.filter_chain(narrow, pattern="ladder", texts=yard, **kwargs)
        assert ids(found) == ids(whole) != []


def test_id_search_is_within_the_tab(spark, yard):
    sample = explore.id_list(spark, [1, 2])
    assert ids(explore.filter_chain(yard, "Sample", "ID:2", sample=sample)) == [2]
    assert ids(explore.filter_chain(yard, "Sample", "ID:5", sample=sample)) == []


def test_tabs(spark, yard, predicted):
    chosen = explore.id_list(spark, ["9", "2", "9"])
    rows = explore.tab(yard, "Selected", selected=chosen).orderBy("pos").collect()
    assert [(r.pos, r.doc_id) for r in rows] == [(0, 9), (1, 2), (2, 9)]
    assert ids(explore.tab(predicted, "Interesting")) == [i for i in EVERY if SCORES[i] > 0.5]
    edge = predicted.withColumn("_pred", F.lit(0.5))
    assert ids(explore.tab(edge, "Interesting")) == []
    events = spark.createDataFrame([(1, 6, 0), (2, 1, 1)], "seq int, doc_id bigint, label int")
    assert ids(explore.tab(labels.apply_labels(yard, events), "Labeled")) == [1, 6]
    assert ids(explore.tab(yard, "All")) == EVERY == ids(explore.tab(yard))
    for name in explore.TABS:
        assert explore.tab(yard, name).count() == 0
        assert explore.tab(yard, name).columns == yard.columns
    unknown = explore.unknown_ids(yard, explore.id_list(spark, [1, 50]))
    assert ids(unknown) == [50]


def test_prediction_range(yard, predicted):
    for low, high in ((SCORES[4], SCORES[9]), (0.0, 0.2), (0.99, 1.0)):
        kept = explore.prediction_range(predicted, low, high)
        assert ids(kept) == [i for i in EVERY if low <= SCORES[i] <= high]
    assert ids(explore.prediction_range(yard, 0.9, 1.0)) == EVERY


def test_sample(yard):
    for n in (len(YARD), 100):
        assert [r.doc_id for r in explore.random_sample(yard, n).collect()] == EVERY
    five = explore.random_sample(yard, 5, seed=1).collect()
    assert len({r.doc_id for r in five}) == 5
    assert five == explore.random_sample(yard, 5, seed=1).collect()
    assert five != explore.random_sample(yard, 5, seed=2).collect()


def test_large_sample_is_exact(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    place = {r.doc_id: r.p for r in df.select("doc_id", explore.sample_order(seed=3).alias("p")).collect()}
    sample = [r.doc_id for r in explore.random_sample(df, 1700, seed=3).collect()]
    assert sample == sorted(place, key=lambda i: (place[i], i))[:1700]


@pytest.mark.parametrize("n", [1, 40, 1700])
@pytest.mark.parametrize(("slack", "listed"), [(6, 10_000), (6, 10), (-0.9, 10_000), (-0.9, 10)])
def test_a_bound_that_is_too_low_is_raised(spark, monkeypatch, n, slack, listed):
    monkeypatch.setattr(explore, "SLACK", slack)
    monkeypatch.setattr(explore, "LISTED_SAMPLE", listed)
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    place = {r.doc_id: r.p for r in df.select("doc_id", explore.sample_order(seed=3).alias("p")).collect()}
    sample = [r.doc_id for r in explore.random_sample(df, n, seed=3).collect()]
    assert sample == sorted(place, key=lambda i: (place[i], i))[:n]


def test_append_to_sample(spark, yard):
    sample = explore.id_list(spark, [4, 2])
    longer = explore.append_to_sample(explore.append_to_sample(sample, 9), 9)
    assert sorted((r.pos, r.doc_id) for r in longer.collect()) == [(0, 4), (1, 2), (2, 9)]


def brute_order(rows, order):
    for name, descending in reversed(order):
        known = [r for r in rows if r[name] is not None]
        known.sort(key=lambda r: r[name], reverse=descending)
        rows = known + [r for r in rows if r[name] is None]
    return rows


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_slices(spark, descending, hot):
    """Slices by stored ranks and from the top equal the sorted list, also when one value fills most rows."""
    chance = random.Random(5)
    rows = [
        (i, "same" if hot and chance.random() < 0.7 else chance.choice([None, "a", "b", "zz"]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, name string").repartition(4)
    order = [("name", descending), ("doc_id", False)]
    want = [r.doc_id for r in brute_order(sorted(df.collect()), order)]
    ranks = ordering.store_ranks(df, order)
    for offset, count in [(0, 30), (95, 10), (300, 250), (595, 10), (700, 5), (590, None)]:
        end = None if count is None else offset + count
        got = ordering.take_slice(df, order, offset, count, ranks=ranks).collect()
        assert [r.doc_id for r in got] == want[offset:end]
        if count is not None:
            got = ordering.take_slice(df, order, offset, count).collect()
            assert [r.doc_id for r in got] == want[offset:end]
    got = ordering.take_slice(df, order, 95, 10, first_rows=7).collect()
    assert [r.doc_id for r in got] == want[95:105]


def test_a_deep_page_reads_one_or_two_files(spark):
    df = spark.range(0, 4000, 1, 5).selectExpr("id AS doc_id", "id % 17 AS name")
    with_aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = ordering.store_ranks(df, [("name", True), ("doc_id", False)])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_aqe)
    assert len(ranks.files) > 4 and sum(rows for _, rows in ranks.files) == 4000
    for offset in (0, 1234, 3990):
        assert len(ranks.slice(offset, 10).inputFiles()) <= 2
        assert [r.rank for r in ranks.slice(offset, 10).orderBy("rank").collect()] == list(range(offset, offset + 10))


def test_ranks_of_a_stored_table_are_kept(spark, tmp_path, monkeypatch):
    place, folder = str(tmp_path / "table"), str(tmp_path / "shared")
    spark.range(50).withColumnRenamed("id", "doc_id").write.parquet(place)
    order = [("doc_id", True)]
    first = ordering.corpus_ranks(spark, place, order, folder)
    assert ordering.corpus_ranks(spark, place, order, folder) == first
    spark.range(50, 60).withColumnRenamed("id", "doc_id").write.mode("append").parquet(place)
    more = ordering.corpus_ranks(spark, place, order, folder)
    assert [r.doc_id for r in more.slice(0, 2).orderBy("rank").collect()] == [59, 58]


def test_an_order_without_a_unique_key_is_refused(spark):
    df = spark.range(50).selectExpr("1 as doc_id")
    with pytest.raises(ValueError, match="unique"):
        ordering.take_slice(df, [("doc_id", False)], 20, 5, first_rows=7)


def test_pages(yard):
    assert [r.doc_id for r in explore.page(yard).collect()] == EVERY[:10]
    assert [r.doc_id for r in explore.page(yard, 2).collect()] == EVERY[10:]
    assert explore.page(yard, 3).count() == 0
    assert [r.doc_id for r in explore.page(yard, 2, 4, "doc_id", True).collect()] == EVERY[::-1][4:8]
    by_text = [r.text for r in explore.page(yard, 1, None, "text").collect()]
    assert by_text == sorted(values(yard, "text"), key=lambda t: t.encode())


def test_page_of_a_list_keeps_its_order(spark, yard):
    rows = explore.tab(yard, "Sample", sample=explore.id_list(spark, [8, 3, 8]))
    assert [r.doc_id for r in explore.page(rows).collect()] == [8, 3, 8]
    assert [r.doc_id for r in explore.page(rows, sort_by="doc_id").collect()] == [3, 8, 8]


def test_page_items(spark, yard, predicted):
    sample = explore.id_list(spark, [7, 7])
    narrow = explore.page(predicted.select("doc_id", "_pred"), 1, 8)
    items = explore.page_items(explore.with_texts(narrow, yard), [ITS], "very", sample).collect()
    by_id = {r.doc_id: r for r in items}
    assert sorted(by_id) == EVERY[:8]
    assert [i for i, r in by_id.items() if r.in_sample] == [7]
    assert by_id[7].text.startswith("<span class='orange--text darken-1'><span style=")
    assert by_id[7].text.count("background-color: white") == 1
    assert by_id[1].text == "<span class='blue--text darken-1'>Rain all week.</span>"


def test_item_view(predicted):
    item = explore.item_view(predicted, 7, [ITS]).first()
    assert (item.title, item.label_text, item.label_class) == ("ID:7", "Not labeled", "")
    assert item.prediction_text == f"Prediction: {SCORES[7]}"
    assert item.text.count("<span") == ITS_COUNTS[7]


def test_export_points(spark, predicted):
    rows = features.featurize(predicted, [ITS, TEST])
    sample = explore.id_list(spark, [6, 7, 0, 7])
    points = explore.export_points(rows, sample, ["_its", "_test"], 0.02, 1.0)
    got = {(r.pos, r.id): r for r in points.collect()}
    assert sorted(got) == [(0, "6"), (1, "7"), (2, "0"), (3, "7")]
    for key, i in (((0, "6"), 6), ((1, "7"), 7), ((2, "0"), 0)):
        total = max(ITS_COUNTS[i] + TEST_COUNTS[i], 1)
        want = {"its": ITS_COUNTS[i] / total, "test": TEST_COUNTS[i] / total}
        assert got[key].weights == pytest.approx(want)
    assert got[1, "7"].color == "#FB8C00" and got[2, "0"].color == "#2196F3"
    untrained = explore.export_points(rows.drop("_pred"), sample, ["_its"]).collect()
    assert {r.color for r in untrained} == {"white"} and not any(r.labeled for r in untrained)


def hits(counts, chosen=EVERY):
    return sum(counts[i] > 0 for i in chosen)


def test_coverage_without_scores(yard):
    rows = features.featurize(yard, [ITS, TEST])
    its, test = stats.coverage(rows, ["_its", "_test"]).collect()
    assert (its.feature, its.total, its.total_pct) == ("its", 3, pytest.approx(3 / 13))
    assert (test.total, test.pos, test.neg, test.pos_pct) == (hits(TEST_COUNTS), 0, 0, 0.0)
    text = stats.coverage_text(stats.coverage(rows, ["_its"]), seeded=False).first()
    assert (text.cov_text, text.pos_text, text.neg_text) == ("23.0% (3)", "", "")


def test_coverage_by_class(predicted):
    row = stats.coverage(features.featurize(predicted, [TEST]), ["_test"]).first()
    high = [i for i in EVERY if SCORES[i] >= 0.5]
    positive = hits(TEST_COUNTS, high)
    assert (row.total, row.pos, row.neg) == (3, positive, 3 - positive) == (3, 1, 2)
    assert (row.pos_pct, row.neg_pct) == (pytest.approx(1 / 3), pytest.approx(2 / 3))
    text = stats.coverage_text(stats.coverage(features.featurize(predicted, [TEST]), ["_test"])).first()
    assert (text.pos_text, text.neg_text) == ("33.3% (1)", "66.6% (2)")


def test_coverage_of_nothing(predicted):
    nothing = KeywordFeature("none", keywords=("brontide",))
    row = stats.coverage(features.featurize(predicted, [nothing]), ["_none"]).first()
    assert (row.total, row.pos_pct, row.neg_pct) == (0, 0.0, 0.0)


def test_histogram(spark, predicted):
    bins = stats.histogram(predicted).orderBy("bin").collect()
    assert len(bins) == 50
    for b in bins:
        assert b["count"] == sum(b.bin < p <= b.bin_end for p in SCORES)
    local = explore.tab(predicted, "Sample", sample=explore.id_list(spark, [0, 9, 5]))
    assert stats.histogram(local).agg(F.sum("count")).first()[0] == 3


def test_histogram_without_scores(yard):
    bins = stats.histogram(yard).collect()
    assert len(bins) == 50 and sum(b["count"] for b in bins) == 0


def test_bins_at_every_edge(spark):
    """Right-closed bins at each edge and at its neighbours among the doubles."""
    import bisect

    import numpy as np

    edges = [k * 0.02 for k in range(51)]
    probes = [p for e in edges for p in (np.nextafter(e, -1), e, np.nextafter(e, 2))]
    probes += [0.0, 1.0, -0.5, 1.5] + list(np.random.default_rng(1).random(3000))
    probes = [float(p) for p in probes]
    rows = spark.createDataFrame(list(enumerate(probes)), "doc_id int, p double")
    got = values(rows.withColumn("b", stats.bin_number(F.col("p"))), "b")
    for p, b in zip(probes, got):
        want = bisect.bisect_left(edges, p) - 1 if 0 < p <= edges[-1] else None
        assert b == want, p


def test_confusion_and_categories(predicted):
    truth = [6, 7, 8, 12]
    row = stats.confusion(predicted, F.col("doc_id").isin(truth)).first()
    high = {i for i in EVERY if SCORES[i] >= 0.5}
    want = (len(high & {*truth}), len({*truth} - high), len(high - {*truth}))
    assert (row.tp, row.fn, row.fp, row.tn) == (*want, len(EVERY) - sum(want))
    parity = predicted.withColumn("odd", F.col("doc_id") % 2 == 1)
    counts = {r.odd: r.n for r in stats.predicted_by_category(parity, "odd").collect()}
    assert counts == {True: sum(i % 2 for i in high), False: sum(i % 2 == 0 for i in high)}


def test_co_activation(yard):
    rows = features.featurize(yard, [ITS, TEST])
    got = {(r._its, r._test): r.n for r in explore.co_activation(rows, ["_its", "_test"]).collect()}
    want = {}
    for i in EVERY:
        key = (ITS_COUNTS[i] > 0, TEST_COUNTS[i] > 0)
        want[key] = want.get(key, 0) + 1
    assert got == want
    assert ids(explore.feature_active(rows, "_its", "_test")) == [4, 6, 7]
