import os
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import jaccard, lines
from siftwork.llm.ship import drop, durable, shared_folder
from tests.llm.conftest import SCHEMA


def set_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1


def firsts(texts):
    """The smallest key of each group, by brute force over all pairs."""
    sets = {k: set_of(t) for k, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8]
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label, links


def varied():
    """Texts of 60 to 400 words, with 0 to 6 words replaced, around a passage that many share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    out = []
    for i in range(40):
        base = [word() for _ in range(rng.randrange(60, 400))] + (passage if i % 2 else [])
        out.append(" ".join(base))
        for changes in range(7):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = word()
            out.append(" ".join(copy[rng.randrange(3) :]))
    return dict(enumerate(out + ["a b", "A b", "a b c d e", "a b c d e f", None, "", " "]))


def test_groups_by_brute_force(spark, monkeypatch):
    texts = varied()
    want, links = firsts(texts)
    assert len(links) > 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    for sample in (1, 16):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == want


def folder_of(docs, path):
    """A folder of tables whose documents are these."""
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stage_removes_copies_at_four_fifths(spark, tmp_path):
    texts = varied()
    want, _ = firsts(texts)
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, folder_of(docs, tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_near_copies_whose_common_lines_are_gone(spark, tmp_path):
    """Nine of ten pairs of likeness 0.8 lose their later member, though line dedup left unlike rests of them."""
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
    texts, near = {}, set()
    for i in range(30):
        base = [line() for _ in range(14)]
        texts[2 * i] = "\n".join(base)
        if i % 3:
            for at in rng.sample(range(14), 2 if i % 3 == 1 else 4):  # more words than line dedup's edits bridge
                words = base[at].split()
                words[5], words[20] = "changed" + str(i), "other" + str(at)
                base[at] = " ".join(words)
            texts[2 * i + 1] = "\n".join(base)
            near.add(2 * i + 1)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], SCHEMA)
    folder = folder_of(docs, tmp_path)
    cut = spark.createDataFrame(corpus_pipeline.line_dedup(spark, docs, folder).collect(), SCHEMA)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert near <= set(left)
    _, links = firsts(texts)
    assert {b for _, b in links} == near and not firsts(left)[1]
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, cut, folder).collect()}
    assert kept == {k: t for k, t in left.items() if k not in near}


def test_range_counts_bound_what_sets_share():
    rng = np.random.default_rng(3)
    pool = rng.integers(-(2**63), 2**63 - 1, 30000)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (0, 1, 5, 300, 3000, 29000, 29500)]
    bounds = np.cumsum([0] + [len(s) for s in sets])
    marks = jaccard.range_counts(np.concatenate(sets), bounds).reshape(len(sets), -1).astype(int)
    assert marks.max() == jaccard.MOST
    for a, x in zip(sets, marks):
        for b, y in zip(sets, marks):
            low = np.minimum(x, y)
            assert len(np.intersect1d(a, b)) <= np.where(low < jaccard.MOST, low, 1 << 40).sum()


def test_earlier_texts_of_odd_rows(spark):
    schema = "doc_id bigint, text string, extra int"
    docs = spark.createDataFrame([(1, "a", 0), (2, None, 0), (3, "c", 0), (3, "d", 0), (None, "x", 0)], schema)
    before = [(1, "a"), (2, "b"), (2, None), (3, "c"), (4, "e"), (None, "y")]
    found = jaccard.earlier_texts(docs, spark.createDataFrame(before, "doc_id bigint, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == [(2, "b"), (2, None)]


def test_empty_and_keyless(spark, empty, tmp_path):
    assert jaccard.classes(empty).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, folder_of(docs, tmp_path))
    assert [r.doc_id for r in kept.collect()].count(None) == 2


def test_fingerprints_name_the_first_pairs(spark, monkeypatch):
    """Near copies meet by their fingerprints; likenesses decide, and the rest is found by shingles."""
    texts = varied()
    want, links = firsts(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    named, original = [], jaccard.verified

    def noticed(pairs, *more):
        found = original(pairs, *more)
        named.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "verified", noticed)
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == want
    assert len(named) == 3 and named[0] > 20


def stored(spark):
    """Folders of tables in the shared folder."""
    return set(os.listdir(shared_folder(spark).removeprefix("file://")))


def test_tables_go_once_they_are_used(spark, tmp_path, monkeypatch):
    """Texts and sets do not stay behind either stage, nor the first shingles beside those that are shared."""
    passage = " ".join(f"w{i}" for i in range(80))
    texts = [passage + "\n" + " ".join(f"u{i}x{j}" for j in range(9 + i)) for i in range(9)] + [passage + " end", passage]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    folder, beside = folder_of(docs, tmp_path), {}
    before = stored(spark)

    def noticed(df, name):
        beside.setdefault(name, []).append({x[:-33] for x in stored(spark) - before})
        return durable(df, name)

    monkeypatch.setattr(jaccard, "durable", noticed)
    kept = corpus_pipeline.near_dedup(spark, docs, folder)
    left = {x[:-33] for x in stored(spark) - before}
    assert left <= {"cut-keys", "shingle-fingerprints", "shingle-groups", "labels"}
    assert len(beside["shingle-links"]) == 3
    assert all(not x & {"shingle-prints", "shingle-sets", "shingles-met"} for x in beside["shingle-links"][1:])
    label, _ = firsts(dict(enumerate(texts)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
    before = stored(spark)
    cut = lines.dedup_lines(docs)
    assert {x[:-33] for x in stored(spark) - before} == {"lines", "first-lines", "line-distances"}
    assert cut.count() == 10  # line by line the last text is a copy


def test_drop_deletes_the_table_alone(spark):
    one, two = (durable(spark.range(5), name) for name in ("one", "two"))
    was = stored(spark)
    drop(one)
    assert {x[:-33] for x in was - stored(spark)} == {"one"} and two.count() == 5


def test_parities_bound_what_sets_share(spark):
    """No linked pair is lost, whatever the sizes, and long sets that share half are told apart."""
    rng = np.random.default_rng(4)
    pool = rng.integers(-(2**63), 2**63 - 1, 40000)
    sizes = [0, 1, 2, 30, 37, 300, 360, 511, 513, 640, 4000, 4097, 5000]
    sets = [np.sort(pool[:n]) for n in sizes] + [np.sort(pool[n // 10 : n + n // 10]) for n in sizes]
    sets += [np.sort(pool[n // 2 : n // 2 + n]) for n in sizes]
    bounds = np.cumsum([0] + [len(s) for s in sets])
    odd, starts = jaccard.parities(np.concatenate(sets), bounds)
    rows = [(i, len(s), odd[a:b].tolist()) for i, (s, a, b) in enumerate(zip(sets, starts[:-1], starts[1:]))]
    table = spark.createDataFrame(rows, "node bigint, n int, odd array<bigint>")
    pairs = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(len(sets))], "a bigint, b bigint")
    found = jaccard.ends(pairs, table).where(jaccard.linked(F.least("n_a", "n_b")))
    left = {(r.a, r.b): r.most for r in found.withColumn("most", jaccard.sharable_by_parity()).collect()}
    linked, kept = 0, 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            share = len(np.intersect1d(x, y))
            if 9 * share >= 4 * (len(x) + len(y)):
                linked += 1
                assert left[i, j] >= share
            elif (i, j) in left and min(len(x), len(y)) >= 300 and share < 0.8 * len(x):
                assert left[i, j] >= share and 9 * left[i, j] < 4 * (len(x) + len(y))
                kept += 1
    assert linked > 100 and kept > 10


def test_unlike_long_texts_are_not_compared_whole(spark, monkeypatch):
    """Of long texts that share a passage, and so counts in each range, no text is taken up again."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(5000)]
    texts = {i: " ".join(passage + [word() for _ in range(3000)]) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    taken, original = [], jaccard.packed

    def noticed(df, name):
        out = original(df, name)
        taken.append((name, out.count()))
        return out

    counted = []

    def stored_too(df, name):
        out = durable(df, name)
        counted.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "packed", noticed)
    monkeypatch.setattr(jaccard, "durable", stored_too)
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {i: i for i in texts}
    assert max(n for name, n in counted if name == "shingle-pairs") > 0  # by counts they might be alike
    assert taken == [("shingle-texts", 0)] * 3


def test_whole_sets_move_in_turns(spark, monkeypatch):
    """A turn has few pairs however many there are; the groups stay those of brute force."""
    texts = varied()
    want, _ = firsts(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    before, turns = stored(spark), []

    def noticed(df, name):
        out = durable(df, name)
        if name == "shingle-turn":
            turns.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "durable", noticed)
    monkeypatch.setattr(jaccard, "AT_ONCE", 1)
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == want
    assert len(turns) >= 2 and sum(turns) > 40 and max(turns) <= 0.8 * sum(turns)
    assert not any(x.startswith("shingle-t") for x in stored(spark) - before)
