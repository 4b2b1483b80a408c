"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule,
so any policy, also a later version, is a mask over stored bits, and the effect of each rule comes from
bitwise aggregation without reading a text again.

A null text has no words and fails the length rule, as does an empty one. Columns of the input that carry
the names of results are kept out of them: `ledger` returns the key and its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import durable, ship
from siftwork.llm.words import (
    Words,
    find_words,
    gram_hashes,
    mix,
    runs,
    slices,
    span_hashes,
    word_hashes,
)

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "alpha_words",
)
SYMBOLS = np.zeros(256, dtype=np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
SEPARATORS = r"[\x20\x09-\x0D]+"
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True
#: Letters A-Z and a-z, and all bytes of characters beyond ASCII.
LETTER = np.zeros(256, dtype=np.int64)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = 1


@dataclass(frozen=True)
class Rule:
    """A name, its bit in the ledger, and the condition over measurements under which it fails."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("short", 0, "n_words < 50"),
    Rule("repeated", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    Rule("letters", 5, "100 * alpha_words < 60 * n_words"),
)
BASE_RULES = ("short", "repeated")
#: A policy lists the rules that reject a document. Versions stay, so that old decisions can be repeated.
POLICIES = {
    0: ("short",),
    1: ("short", "repeated"),
    2: ("short", "repeated", "symbols", "duplicate_lines", "word_length", "letters"),
}
CURRENT = 2
#: For texts that were cut after the current policy had kept them.
LENGTH = 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups that may be empty."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position whether its key occurs twice or more, and whether it is a later occurrence."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again, twice = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def repeat_words(words: Words) -> np.ndarray:
    """Words in windows of three that the same text holds twice or more."""
    text = words.text_of_word()
    grams = gram_hashes(word_hashes(words), 3)
    inside = text[: len(grams)] == text[2:] if len(grams) else np.empty(0, dtype=bool)
    at = np.flatnonzero(inside)
    twice, _ = repeated(grams[at] ^ mix(text[at].astype(np.uint64)))
    covered = np.zeros(len(text), dtype=np.int64)
    for j in range(3):
        covered[at[twice] + j] = 1
    return sums(covered, words.first)


def line_counts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those equal to an earlier one of their text."""
    lines = runs(words.data, words.bounds, NEWLINE)
    has = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    start, end, text = lines.start[has], lines.end[has], lines.text_of_word()[has]
    keys = span_hashes(words.data, start, end) ^ mix(text.astype(np.uint64))
    _, again = repeated(keys)
    n = len(words.first) - 1
    return np.bincount(text, minlength=n), np.bincount(text[again], minlength=n)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of some texts."""
    words = find_words(texts)
    n_lines, n_dup_lines = line_counts(words)
    lead = np.zeros(len(words.data) + 1, dtype=np.int64)  # code points ahead of each byte
    np.cumsum((words.data & 0xC0) != 0x80, out=lead[1:])
    letters = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum(LETTER[words.data], out=letters[1:])
    return {
        "n_words": words.counts(),
        "word_chars": sums(lead[words.end] - lead[words.start], words.first),
        "n_symbols": sums(SYMBOLS[words.data], words.bounds),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": repeat_words(words),
        "n_lines": n_lines,
        "alpha_words": sums(letters[words.end] > letters[words.start], words.first),
    }


def measures(text: str) -> Column:
    """A struct of the measurements of a text column."""

    @F.arrow_udf("struct<" + ", ".join(f"{name}: bigint" for name in MEASURES) + ">")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [measure(batch.slice(i, j - i)) for i, j in slices(batch)]
            columns = [
                pa.array(np.concatenate([p[name] for p in parts] or [[]]), pa.int64()) for name in MEASURES
            ]
            yield pa.StructArray.from_arrays(columns, names=list(MEASURES))

    return compute(F.col(text).cast("string"))


def word_count(text: str) -> Column:
    """n_words of a text column by SQL functions only."""
    words = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SEPARATORS, -1)
    return F.size(F.filter(words, lambda w: w != "")).cast("bigint")


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One long with a bit set for each rule that fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return out


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    known = {r.name: 1 << r.bit for r in rules}
    return sum(known[name] for name in set(names))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, measurements and failure bits of each row, in one pass over the texts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key), measures(text).alias("measured")).select(key, "measured.*")
    return rows.withColumn("failures", failure_bits())


def stored_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger, written once: policies and ablations read it and never a text."""
    return durable(ledger(docs, key, text), "quality-ledger")


def passes(policy: int = CURRENT) -> Column:
    """Whether the failure bits satisfy a version of the policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents it rejects, those it alone rejects, those kept without it.

    Bit patterns are counted first, so what is shuffled and joined is bounded by their number.
    """
    names = POLICIES[policy]
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(names))).alias("bits")).count()
    found = [F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).cast("long").alias("bit")) for n in names]
    each = patterns.select("bits", "count", F.explode(F.array(*found)).alias("r"))
    bit, others = F.col("r.bit"), F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    hit = F.col("bits").bitwiseAND(bit) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("rejects"),
        F.sum(F.when(hit & (others == 0), F.col("count")).otherwise(0)).alias("rejects_alone"),
        F.sum(F.when(others == 0, F.col("count")).otherwise(0)).alias("kept_without"),
    )


def only_rule(policy: int = CURRENT) -> Column:
    """The rule that alone rejects a document under a policy; null if none or several do."""
    failed = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.coalesce(*[F.when(failed == mask((name,)), F.lit(name)) for name in POLICIES[policy]])


def ablation_report(rows: DataFrame, policy: int = CURRENT) -> DataFrame:
    """One row, `ablation`: rule:rejects:rejects_alone:kept_without by rule, in the order of names; "" for no rows."""
    line = F.concat_ws(":", "rule", "rejects", "rejects_alone", "kept_without")
    found = ablations(rows, policy).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return found.select(F.array_join("lines", ",").alias("ablation"))


def filter_documents(docs: DataFrame, policy: int = CURRENT, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with.

    Null, empty and repeated rows are judged one by one; the input may have any further columns.
    """
    ship(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = docs.select(row, measures(text).alias("m"))
    judged = judged.select("row", "m.*").withColumn("failures", failure_bits())
    return judged.where(passes(policy)).select("row.*")


def filter_by_length(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the policy LENGTH keeps, like filter_documents, by SQL functions only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    judged = docs.select(row, word_count(text).alias("n_words"))
    fails = failure_bits(tuple(r for r in RULES if r.name in POLICIES[LENGTH]))
    return judged.withColumn("failures", fails).where(passes(LENGTH)).select("row.*")
