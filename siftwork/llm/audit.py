"""Filter interaction audit by potentials of the removal game.

The players are filters, the worth of a coalition is the number of documents that fail one of its filters.
Documents are reduced to counts per part and failure pattern. From those the worth of all coalitions follows,
and the Hart-Mas-Colell potential of each from the potentials of the coalitions without one filter:
P(S) = (v(S) + sum of P(S - i)) / |S|. The Shapley value of a filter is the potential of all filters minus the
potential without it, and each step of each order is a difference of two coalitions' worth. Potentials are kept
as whole numbers, |S|! P(S), so nothing is rounded.

Texts are read once and never shuffled: a row becomes its id, a 256-bit digest of the text, a failure pattern
and its part. Copies are recognised by the digest. Counts are made ahead of each shuffle, so a text or a part
that holds a third of all rows costs no more than others.

Null texts are empty, and equal to each other. A null id is neither earlier nor later than another one, so it
never fails the rule on copies and makes no other row fail it. Repeated rows count each time; rows of one id
and one text do not make each other copies. Of several label rows of a document one that says 1 decides; null
labels, and documents without any, are neither good nor toxic. An empty table gives no rows. Very long texts
are judged whole. The input may have any columns, also ones named like results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that separates words.
GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Filter:
    """A letter, and the condition under which a document fails: SQL over `t` (text), `w` (words), or copies."""

    letter: str
    fails: str | None  # None: the text is that of a smaller id


FILTERS = (
    Filter("A", "size(w) < 100"),
    Filter("B", "100 * size(array_distinct(w)) < 80 * size(w)"),
    Filter("C", "100 * regexp_count(t, '[A-Z]') > 10 * length(t)"),
    Filter("D", r"t rlike '[#$%&*|]'"),
    Filter("E", None),
)
#: What is counted per pattern: all documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")


def own_failures(filters: Sequence[Filter]) -> Column:
    """Bits of the filters that look at one text alone."""
    bits = [f"CASE WHEN {f.fails} THEN {1 << i} ELSE 0 END" for i, f in enumerate(filters) if f.fails]
    return F.expr(" + ".join(bits) if bits else "0")


def patterns(
    docs: DataFrame,
    labels: DataFrame,
    filters: Sequence[Filter] = FILTERS,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """Documents, good and toxic ones per part and failure pattern: (part, bits, n, good, toxic)."""
    texts = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    words = texts.withColumn("w", F.array_remove(F.split("t", GAP), ""))
    read = words.select("key", "part", F.sha2("t", 256).alias("hex"), own_failures(filters).alias("own"))
    rows = read.select("key", "part", F.unhex("hex").alias("digest"), "own")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = rows.join(known, "key", "left").fillna(0, ["good", "toxic"])
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    # groups of one text, part and label: all rows, the smallest id and its rows, rows without an id
    groups = rows.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("first"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    lead = F.min("first.key").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.key") == lead, F.col("first.n")).otherwise(0) + F.col("nameless")
    judged = groups.select("part", "own", "good", "toxic", "n", first.alias("kept"))
    copy = sum(1 << i for i, f in enumerate(filters) if f.fails is None)
    split = judged.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("own").alias("bits"), (F.col("kept") if copy else F.col("n")).alias("n")),
            F.struct(F.col("own").bitwiseOR(F.lit(copy)).alias("bits"), (F.col("n") - F.col("kept") if copy else F.lit(0)).alias("n")),
        )).alias("side"),
    )
    n = F.col("side.n")
    return (
        split.where(n > 0)
        .groupBy("part", F.col("side.bits").alias("bits"))
        .agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))
    )


def worths(counted: DataFrame, n_filters: int) -> DataFrame:
    """Per part, for all documents, good and toxic ones, the worth of each coalition as an array by its bits."""
    def worth(column: str) -> Column:
        sums = [
            F.sum(F.when(F.col("bits").bitwiseAND(F.lit(s)) != 0, F.col(column)).otherwise(0))
            for s in range(1 << n_filters)
        ]
        return F.array(*sums).alias(column)

    return counted.groupBy("part").agg(F.sum("n").alias("total"), *[worth(c) for c in COUNTS])


def potentials(worth: str, n_filters: int) -> Column:
    """|S|! P(S) of each coalition S, an array by its bits, from the array of worths.

    A coalition's number is larger than those of its parts, so one pass over the numbers has all it needs.
    """
    sizes = F.array(*[F.lit(factorial(max(0, s.bit_count() - 1))).cast("long") for s in range(1 << n_filters)])

    def step(done: Column, s: Column) -> Column:
        without = [
            F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(done, s.bitwiseAND(F.lit(~(1 << i))))).otherwise(F.lit(0))
            for i in range(n_filters)
        ]
        value = F.get(sizes, s) * F.get(F.col(worth), s)
        for other in without:
            value = value + other
        return F.array_append(done, value)

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), step)


def shapley(worth: str, potential: str, n_filters: int) -> Column:
    """Each filter's removals summed over all orders: n! times its Shapley value."""
    everyone = (1 << n_filters) - 1
    return F.array(*[
        F.get(potential, F.lit(everyone)) - n_filters * F.get(potential, F.lit(everyone ^ (1 << i)))
        for i in range(n_filters)
    ])


def steps(filters: Sequence[Filter]) -> Column:
    """All steps of all orders: the order, the step, the filter's number, and the coalition ahead of it."""
    out = []
    for order in permutations(range(len(filters))):
        name = "".join(filters[i].letter for i in order)
        ahead = 0
        for step, i in enumerate(order, 1):
            out.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'i', {i}, 'ahead', {ahead})")
            ahead |= 1 << i
    return F.expr(f"array({', '.join(out)})")


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Sequence[Filter] = FILTERS,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the step and the filter's value."""
    m = len(filters)
    games = worths(patterns(docs, labels, filters, key, text, part), m)
    games = games.withColumn("potential", potentials("n", m))
    games = games.withColumn("value", shapley("n", "potential", m)).drop("potential")
    rows = games.withColumn("s", F.explode(steps(filters)))
    ahead, own = F.col("s.ahead"), F.expr("shiftleft(1, s.i)")
    behind = ahead.bitwiseOR(own)
    others = F.lit((1 << m) - 1).bitwiseXOR(own)

    def gain(column: str) -> Column:
        return F.get(column, behind) - F.get(column, ahead)

    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        (F.col("total") - F.get("n", behind)).alias("kept"),
        gain("n").alias("removed"),
        (F.get("n", own) - gain("n")).alias("redundant"),
        (F.get("n", F.lit((1 << m) - 1)) - F.get("n", others)).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        F.get("value", F.col("s.i")).alias("shapley"),
    )
