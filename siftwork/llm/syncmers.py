"""Document fingerprints from closed syncmers.

Five neighbouring words are an anchor when the smallest hash of their inner word pairs belongs to the first
or the last pair. Whether a place is an anchor depends on its five words only, so equal passages have equal
anchors wherever they stand, at equal distances. The fingerprint of a text is the sketch of its anchors: the
64 smallest distinct hashes, of all of them. Its likeness to another is the share of the smallest hashes of
both that both hold, which estimates the share of common anchors.

A text without an anchor has one made of all its words, and one without a word has that of no words, so a
null text is like an empty one. Repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.ship import durable

WORDS = 5
SKETCH = 64
SEPARATORS = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS, -1), lambda w: w != "")


def short(h: Column) -> Column:
    return h.bitwiseAND(F.lit(2147483647)).cast("int").alias("hash")


def anchors(words: Column) -> Column:
    """array<struct<at, hash>> of a column of word lists: place of the first word, 31-bit hash."""

    def pick(s: Column, i: Column) -> Column:
        edge = F.least(s[i], s[i + 3]) < F.least(s[i + 1], s[i + 2])
        return F.when(edge, F.struct(i.alias("at"), short(F.xxhash64(s[i], s[i + 2], s[i + 3]))))

    def places(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(s) - 4), lambda i: pick(s, i))
        return F.when(F.size(s) >= 4, F.filter(every, lambda x: x.isNotNull()))

    def pairs(h: Column) -> Column:
        ahead = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.zip_with(ahead, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))

    def whole(h: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("at"), short(F.xxhash64(h))))

    def found(h: Column) -> Column:
        inner = F.transform(F.array(pairs(h)), places)[0]
        return F.transform(F.array(inner), lambda p: F.when(F.size(p) > 0, p).otherwise(whole(h)))[0]

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), found)[0]


def with_sketches(rows: DataFrame, names: dict[str, str], size: int = SKETCH) -> DataFrame:
    """Sketches of text columns in place of them: the smallest distinct hashes of their anchors.

    The same hashes as those of `anchors`, without their places. Each step is a column of its own, which Spark hands on as
    a packed array of numbers; as one nested expression, all steps of a text are lists of objects at the same time.
    """
    texts, others = list(names), [c for c in rows.columns if c not in names]

    def step(frame: DataFrame, *made: Column) -> DataFrame:
        return frame.select(*others, *made)

    def chosen(s: str) -> Column:
        p, at = F.col(s), F.sequence(F.lit(0), F.size(s) - 4)
        edge = lambda i: F.least(p[i], p[i + 3]) < F.least(p[i + 1], p[i + 2])
        found = F.transform(F.filter(at, edge), lambda i: short(F.xxhash64(p[i], p[i + 2], p[i + 3])))
        return F.when(F.size(s) >= 4, F.sort_array(F.array_distinct(found)))

    def neighbours(h: str) -> Column:
        ahead = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
        return F.zip_with(ahead, F.slice(h, F.lit(2), F.size(h)), lambda a, b: F.xxhash64(a, b))

    out = step(rows, *[F.transform(word_list(F.col(t)), lambda w: F.xxhash64(w)).alias(t) for t in texts])
    whole = [short(F.xxhash64(t)).alias(f"{t} whole") for t in texts]
    out = step(out, *whole, *[neighbours(t).alias(t) for t in texts])
    out = step(out, *[F.col(f"`{t} whole`") for t in texts], *[chosen(t).alias(t) for t in texts])
    lowest = [F.when(F.size(t) > 0, F.slice(t, 1, size)).otherwise(F.array(F.col(f"`{t} whole`"))) for t in texts]
    return step(out, *[c.alias(names[t]) for c, t in zip(lowest, texts)])


def as_text(sketched: str) -> Column:
    return F.concat_ws("", F.transform(sketched, lambda h: F.lower(F.lpad(F.hex(h.cast("long")), 8, "0"))))


def likeness(a: str, b: str, size: int = SKETCH) -> Column:
    """Share of the smallest hashes of both sketches that both hold, from 0 to 1."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.size(F.array_intersect(low, F.array_intersect(a, b))) / F.size(low)


def shifts(a: str, b: str) -> Column:
    """array<struct<at, shift>>: where anchors of `a` occur in `b`, for positional matching.

    `a` and `b` are anchor columns; a hash that `b` holds more than once matches at its first place.
    """
    first = f"map_from_entries(transform(array_distinct(transform({b}, y -> y.hash)), h -> struct(h, filter({b}, y -> y.hash = h)[0].at)))"
    return F.expr(
        f"""transform(array({first}), m -> filter(transform({a}, x -> named_struct('at', x.at, 'shift', m[x.hash] - x.at)),
            x -> x.shift is not null))[0]"""
    )


def following(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, next, give_to, give): the next larger key, the one before, and how many characters that takes.

    Keys are ordered over ranges, so no task holds them all; the first key of each range, one row per
    partition, links it to the one before. After the last key comes the first. Null keys have no place.
    """
    keys = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    keys = keys.agg(F.max(F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("int")).alias("quarter"))
    ranged = durable(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ordered-keys")
    ends = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max_by("quarter", "key").alias("q"), F.max("key").alias("last"))
    order = Window.orderBy("part")  # one row per partition
    around = Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(order), F.min("first").over(around)).alias("after"),
        F.coalesce(F.lag("last").over(order), F.max("last").over(around)).alias("before"),
        F.coalesce(F.lag("q").over(order), F.max_by("q", "last").over(around)).alias("before_quarter"),
    )
    inside = Window.partitionBy("part").orderBy("key")
    rows = ranged.join(F.broadcast(ends), "part")
    return rows.select(
        "key",
        F.coalesce(F.lead("key").over(inside), "after").alias("next"),
        F.coalesce(F.lag("key").over(inside), "before").alias("give_to"),
        F.coalesce(F.lag("quarter").over(inside), "before_quarter").alias("give"),
    )


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row with a key: n_chars, the digest of the edited text, and sketches of both texts and the next.

    The edited text has its last quarter replaced by the beginning of the next document. Of each document
    only as many characters are sent as the one before it takes. Where rows share a key, the beginning that
    sorts first and its sketch are the next document's.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = rows.join(following(docs, key, text), "key")
    lead = placed.select(F.col("give_to").alias("key"), F.substring("text", F.lit(1), F.col("give")).alias("lead"))
    lead = lead.groupBy("key").agg(F.min("lead").alias("lead"))
    both = placed.select("key", "text", "next").join(lead, "key")
    quarter = F.floor(F.length("text") / 4).cast("int")
    kept = F.substring("text", F.lit(1), F.length("text") - quarter)
    both = both.withColumn("edited", F.concat(kept, F.substring("lead", F.lit(1), quarter)))
    both = both.select(
        "key",
        "next",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "text",
        "edited",
    )
    sketched = durable(with_sketches(both, {"text": "sketch", "edited": "edited_sketch"}), "sketches")
    after = sketched.groupBy(F.col("key").alias("next")).agg(F.min("sketch").alias("next_sketch"))
    return sketched.join(after, "next")
