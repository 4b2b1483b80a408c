import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from siftwork.llm import simhash
from siftwork.llm.components import connect


def print_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component of each key by brute force over all pairs."""
    keys = sorted(prints)
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    label[a], changed = label[b], True
    return label


def test_fingerprints_and_components(odd, odd_rows, empty):
    got = simhash.classes(odd).select("doc_id", simhash.as_hex("fp").alias("h"), "component_id").collect()
    prints = {d: print_of(t) for d, t, *_ in odd_rows}
    assert {r.doc_id: int(r.h, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == groups(prints)
    assert all(len(r.h) == 16 for r in got)
    assert simhash.classes(empty).count() == 0


def test_every_close_pair_is_found(spark):
    rng = random.Random(3)
    near = [rng.getrandbits(64) for _ in range(40)]
    for base in list(near):
        for flips in (1, 2, 2, 3, 4):
            near.append(base ^ sum(1 << b for b in rng.sample(range(64), flips)))
    near = sorted({x - (1 << 63) for x in near})
    rows = simhash.close_pairs(spark.createDataFrame([(x,) for x in near], "fp bigint")).collect()
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(a, b) for a in near for b in near if a < b and bits(a, b) <= 2}
    assert len(rows) == len(want) and {(r.fp_a, r.fp_b) for r in rows} == want


def test_pivots_never_discard_a_close_pair(spark):
    rows = spark.createDataFrame([(5, 5 ^ (1 << 63) - 1 ^ (1 << 62) - 1), (7, -7), (0, 3)], "x bigint, y bigint")
    a = rows.select(F.struct(*simhash.pivot_distances(F.col("x"))).alias("a"), "x", "y")
    both = a.select("a", F.struct(*simhash.pivot_distances(F.col("y"))).alias("b"), "x", "y")
    kept = both.where(simhash.coordinates_within("a", "b", 2)).select("x", "y").collect()
    assert (0, 3) in {(r.x, r.y) for r in kept} and (7, -7) not in {(r.x, r.y) for r in kept}


@pytest.mark.parametrize("length", [1, 2, 37])
def test_chains_connect(spark, length):
    links = [(i, i + 1) for i in range(length)] + [(100, 100), (200, 205), (205, 203)]
    found = connect(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {i: 0 for i in range(length + 1)} | {200: 200, 203: 200, 205: 200}


def test_one_of_each_group_stays(odd, odd_rows, empty, spark):
    label = groups({d: print_of(t) for d, t, *_ in odd_rows})
    kept = simhash.keep_first(odd.union(odd))
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))
    assert simhash.keep_first(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d")], "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.keep_first(nameless).collect()].count(None) == 2
