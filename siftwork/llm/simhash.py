"""SimHash near-duplicates by pivot distance tables.

Fingerprints are compared as distinct values, so copies cost one row. Two of them that differ in at most
`BITS` bits agree on all but `BITS` of `BLOCKS` bit ranges, so every pair in question meets under one of the
keys made of the remaining ranges. Each fingerprint carries its precomputed distances to a fixed list of
reference fingerprints: by the triangle inequality a pair whose distances to any reference differ by more
than `BITS` is discarded, and the rest is verified on the fingerprints.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.components import connect
from siftwork.llm.ship import durable, ship
from siftwork.llm.words import Words, find_words, slices

SEED = 42
SHINGLE = 3
BITS = 2
BLOCKS = 6
PIVOTS = 16


def fingerprints(words: Words, shingle: int = SHINGLE) -> np.ndarray:
    """One signed 64-bit fingerprint per text."""
    n = len(words.first) - 1
    out = np.zeros(n, dtype=np.uint64)
    if not len(words.start):
        return out.view(np.int64)
    size = words.end - words.start
    begin = np.cumsum(size + 1) - size - 1  # in the words joined by one space
    take = np.repeat(words.start - begin, size + 1) + np.arange(int((size + 1).sum()))
    joined = words.data[np.minimum(take, len(words.data) - 1)]
    joined[begin + size] = 32
    raw = joined.tobytes()
    counts = words.counts()
    grams = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    first = np.cumsum(grams) - grams
    text = np.repeat(np.arange(n), grams)
    low = words.first[:-1][text] + np.arange(len(text)) - first[text]
    high = low + np.minimum(counts, shingle)[text] - 1
    digest = xxhash.xxh64_intdigest
    stops = (begin + size)[high].tolist()
    hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begin[low].tolist(), stops)], dtype=">u8")
    full = np.flatnonzero(grams)
    for i in range(0, len(full), 64):  # bits of some texts at a time
        some = full[i : i + 64]
        a, b = first[some[0]], first[some[-1]] + grams[some[-1]]
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first[some] - a, axis=0, dtype=np.int64)
        major = np.packbits(2 * ones > grams[some][:, None], axis=1)
        out[some] = np.ascontiguousarray(major).view(">u8").ravel()
    return out.view(np.int64)


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column as a long."""

    @F.arrow_udf("bigint")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fingerprints(find_words(batch.slice(i, j - i), lower=True)) for i, j in slices(batch)]
            yield pa.array(np.concatenate(parts or [np.empty(0, dtype=np.int64)]), pa.int64())

    return compute(F.col(text).cast("string"))


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints, spread by a hash."""
    return [xxhash.xxh64_intdigest(str(i), SEED) - (1 << 63) for i in range(count)]


def pivot_distances(fp: Column) -> list[Column]:
    """Distances to all references, eight to a long."""
    found = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    out = []
    for i in range(0, len(found), 8):
        packed = found[i]
        for j, d in enumerate(found[i + 1 : i + 8], 1):
            packed = packed.bitwiseOR(F.shiftleft(d, 8 * j))
        out.append(packed.alias(f"d{i // 8}"))
    return out


def coordinates_within(left: str, right: str, bits: int) -> Column:
    """Whether the largest coordinate difference is at most `bits`."""
    far = []
    for i in range(PIVOTS):
        a, b = (
            F.shiftright(F.col(f"{side}.d{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(127).cast("long"))
            for side in (left, right)
        )
        far.append(F.abs(a - b))
    return F.greatest(*far) <= bits


def block_keys(fp: Column, bits: int = BITS, blocks: int = BLOCKS) -> Column:
    """One (table, masked fingerprint) per choice of the bit ranges that agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    keys = []
    for i, chosen in enumerate(combinations(masks, blocks - bits)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).alias("table"), fp.bitwiseAND(F.lit(signed).cast("long")).alias("part")))
    return F.array(*keys)


def close_pairs(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (fp_a, fp_b) of distinct fingerprints (fp) that differ in at most `bits` bits, each once."""
    table = distinct.select("fp", *pivot_distances(F.col("fp")))
    keyed = table.select(F.explode(block_keys(F.col("fp"), bits)).alias("k"), "fp", "d0", "d1")
    keyed = keyed.select("k.table", "k.part", "fp", "d0", "d1")
    a, b = keyed.alias("a"), keyed.alias("b")
    met = (F.col("a.table") == F.col("b.table")) & (F.col("a.part") == F.col("b.part"))
    pairs = a.join(b, met & (F.col("a.fp") < F.col("b.fp")) & coordinates_within("a", "b", bits))
    pairs = pairs.select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))
    return pairs.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """(key, fp, component_id) per row: the smallest key reachable over links, its own included."""
    ship(docs.sparkSession)
    prints = durable(docs.select(F.col(key).alias("key"), fingerprint(text).alias("fp")), "fingerprints")
    nodes = durable(prints.groupBy("fp").agg(F.min("key").alias("low")), "fingerprint-nodes")
    pairs = durable(close_pairs(nodes.select("fp"), bits), "fingerprint-pairs")
    low_a, low_b = nodes.toDF("fp_a", "a"), nodes.toDF("fp_b", "b")
    found = connect(pairs.join(low_a, "fp_a").join(low_b, "fp_b").select("a", "b"))
    joined = nodes.join(found, nodes["low"] == found["node"], "left")
    named = joined.select("fp", F.coalesce("component", "low").alias("component_id"))
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One document of each component, the one with the smallest key, with the columns it came with.

    Of rows that share a key one stays. Rows without a key can't be named in a component and stay.
    """
    return without_later(docs, classes(docs, key, text, bits), key)


def without_later(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is the component_id of their component; `found` has both."""
    later = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("later")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(key).alias("own")).join(later, F.col("own") == F.col("later"), "left_anti")
    apart = F.when(F.col("own").isNull(), F.monotonically_increasing_id())
    return rows.withColumn("apart", apart).dropDuplicates(["own", "apart"]).select("row.*")
