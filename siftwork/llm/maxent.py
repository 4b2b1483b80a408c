"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Words have classes: the most frequent ones and the end of a text a class each, all others one by the hash of
their last two bytes. The probability of a token is that of its class times that of the word in its class.
Classes are factored once more, into groups and their members: two small log-linear models over the same hashed
features of the words before (each of the last three alone, as skips, and the last two together) give the group
and the member of the group. Words within a class are smoothed relative frequencies, with one share for all words
never seen, so the probabilities of a class add up to one.

Counts of all training words are gathered by Spark. Training goes in rounds over disjoint halves of the
training texts: each task starts from the shared weights and makes gradient updates over its texts, and the
weights of each feature are then averaged over tasks by how often they met it. Counts of frequent words are
sent to the tasks, up to a fixed number; those of all others join by the word, and by their rank none of
them is frequent enough to be a hot key.

Tokens are words after lower-casing A-Z, and one end per text. Null texts are empty. Repeated rows are
scored each. Without training texts every word is unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import cleaned_up, durable, ship
from siftwork.llm.words import BASE, Words, find_words, mix, slices, word_hashes

HEAD_WORDS = 200_000
SINGLES = 24
SUFFIXES = 24
CLASSES = SINGLES + SUFFIXES
GROUPS = 8
MEMBERS = CLASSES // GROUPS
#: Weights of a bucket: one per group, then one per class, those of a group side by side.
WEIGHTS = GROUPS + CLASSES
BUCKET_BITS = 16
BATCH = 4096
RATE = 0.1
#: Texts that are learned from or scored at once, in bytes; a longer one is taken by itself.
SLICE_BYTES = 1 << 20
SCORED_TOKENS = 1 << 17
ROUNDS = 2
FEATURES = 4
END = np.uint64(0x5EED0E4D)
BEFORE = np.uint64(0x5EED0BE6)
WORD_COUNTS = "word binary, n bigint"


def suffix_class(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of a word by its last two bytes."""
    last = data[end - 1].astype(np.uint64)
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    return SINGLES + (mix(before << np.uint64(8) | last) % np.uint64(SUFFIXES)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts of a partition, summed over some megabytes at a time."""
    for batch in batches:
        for i, j in slices(batch.column(0), 8 << 20):
            words = find_words(batch.column(0).slice(i, j - i), lower=True)
            if len(words.start):
                yield unique_words(words)


def unique_words(words: Words) -> pa.RecordBatch:
    _, one, n = np.unique(word_hashes(words), return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [spans(words.data, words.start[one], words.end[one]), pa.array(n.astype(np.int64))], names=["word", "n"]
    )


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of bytes as an array of binary values."""
    size = end - start
    bounds = np.zeros(len(size) + 1, dtype=np.int32)
    np.cumsum(size, out=bounds[1:])
    take = np.repeat(start - bounds[:-1], size) + np.arange(int(bounds[-1]))
    body = np.ascontiguousarray(data[take]) if len(take) else np.empty(0, dtype=np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(body.tobytes())])


def class_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, tokens, words) of word counts."""
    for batch in batches:
        words, n = batch.column(0), batch.column(1).to_numpy()
        if not len(words):
            continue
        raw = words.cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)
        own = suffix_class(data, bounds[:-1], bounds[1:])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(CLASSES)),
                pa.array(np.bincount(own, weights=n, minlength=CLASSES).astype(np.int64)),
                pa.array(np.bincount(own, minlength=CLASSES).astype(np.int64)),
            ],
            names=["class", "tokens", "words"],
        )


@dataclass
class Counts:
    """Sums over the training tokens, and the most frequent words."""

    tokens: int  # with ends
    distinct: int  # with the end
    ends: int
    hashes: np.ndarray  # of frequent words, sorted
    counts: np.ndarray
    single: np.ndarray  # their class, or -1 where it goes by the suffix (the first of them have one)
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base_share(self) -> float:
        return np.log10(self.tokens + 0.5 * (self.distinct + 1))

    def class_share(self) -> np.ndarray:
        return np.log10(self.class_tokens + 0.5 * (self.class_words + 1))


@dataclass
class Model:
    counts: Counts
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BUCKET_BITS, WEIGHTS), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS, dtype=np.float32))


@dataclass
class Tokens:
    """Words of some texts with one end behind each text."""

    words: Words
    hashes: np.ndarray  # of all tokens
    text: np.ndarray
    is_end: np.ndarray
    head: np.ndarray  # place among frequent words, or -1
    classes: np.ndarray
    features: np.ndarray  # one row of buckets per token


def tokens_of(texts: pa.Array, counts: Counts, singles_only: bool = False) -> Tokens:
    """Tokens with classes and features; `singles_only` looks up no words but those with a class of their own."""
    known = counts.single >= 0 if singles_only else slice(None)
    frequent, own_class = counts.hashes[known], counts.single[known]
    words = find_words(texts, lower=True)
    n = len(words.first) - 1
    stops = words.first[1:]
    hashes = np.insert(word_hashes(words), stops, END)
    text = np.insert(words.text_of_word(), stops, np.arange(n))
    is_end = np.zeros(len(hashes), dtype=bool)
    is_end[stops + np.arange(n)] = True
    head = np.full(len(hashes), -1, dtype=np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        head = np.where((frequent[place] == hashes) & ~is_end, place, -1)
    classes = np.zeros(len(hashes), dtype=np.int64)
    classes[~is_end] = suffix_class(words.data, words.start, words.end)
    if len(frequent):
        single = np.where(head >= 0, own_class[head], -1)
        classes = np.where(single >= 0, single, classes)
    place = np.arange(len(hashes)) - (words.first[:-1] + np.arange(n))[text]
    before = []
    for k in range(1, 4):
        shifted = np.full(len(hashes), BEFORE, dtype=np.uint64)
        shifted[k:] = hashes[: max(len(hashes) - k, 0)]
        before.append(np.where(place >= k, shifted, BEFORE))
    keys = [mix(b + np.uint64(k)) for k, b in enumerate(before)] + [mix(before[0] * BASE + before[1])]
    features = np.stack([(k >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for k in keys], axis=1)
    return Tokens(words, hashes, text, is_end, head, classes, features)


def log_softmax(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural log probabilities, one row per outcome and one column per token; `weights` has a row per outcome."""
    out = np.empty((len(weights), len(features)), dtype=np.float32)
    for outcome, own in enumerate(weights):
        total = own[features[:, 0]]
        for k in range(1, FEATURES):
            total = total + own[features[:, k]]
        out[outcome] = total + bias[outcome]
    out -= out.max(axis=0)
    out -= np.log(np.exp(out).sum(axis=0))
    return out


@dataclass
class Layers:
    """The weights by outcome: of the groups, and of the members of each group."""

    groups: np.ndarray  # groups x buckets
    group_bias: np.ndarray
    members: np.ndarray  # groups x members x buckets
    member_bias: np.ndarray

    @staticmethod
    def of(weights: np.ndarray, bias: np.ndarray) -> Layers:
        by_outcome = np.ascontiguousarray(weights.T)
        members = by_outcome[GROUPS:].reshape(GROUPS, MEMBERS, -1)
        return Layers(by_outcome[:GROUPS].copy(), bias[:GROUPS].copy(), members, bias[GROUPS:].reshape(GROUPS, MEMBERS).copy())

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        weights = np.concatenate([self.groups, self.members.reshape(CLASSES, -1)]).T
        return np.ascontiguousarray(weights), np.concatenate([self.group_bias, self.member_bias.ravel()])

    def log_of(self, features: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log probability of the class of each token."""
        group, member = classes // MEMBERS, classes % MEMBERS
        out = log_softmax(self.groups, self.group_bias, features)[group, np.arange(len(classes))]
        for g in np.unique(group).tolist():
            at = np.flatnonzero(group == g)
            inside = log_softmax(self.members[g], self.member_bias[g], features[at])
            out[at] += inside[member[at], np.arange(len(at))]
        return out


def log_classes(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes, one row per token."""
    layers = Layers.of(weights, bias)
    groups = log_softmax(layers.groups, layers.group_bias, features)
    inside = [log_softmax(layers.members[g], layers.member_bias[g], features) + groups[g] for g in range(GROUPS)]
    return np.concatenate(inside).T


class Softmax:
    """Gradient updates of one small model, outcomes by buckets, in place.

    Slopes are summed per bucket by counting, over all buckets at once, so a batch needs no sorting and its
    arrays fit a core's cache.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights, bias
        self.scale = np.full(weights.shape[1], 1e-3, dtype=np.float32)
        self.bias_scale = np.float32(1e-3)
        self.met = np.zeros(weights.shape[1], dtype=np.int64)
        self.tokens = 0

    def learn(self, features: np.ndarray, outcomes: np.ndarray) -> None:
        wrong = np.exp(log_softmax(self.weights, self.bias, features)).astype(np.float64)
        wrong[outcomes, np.arange(len(outcomes))] -= 1
        keys = features.T.ravel()
        buckets = self.weights.shape[1]
        slope = np.empty(self.weights.shape, dtype=np.float32)
        for outcome, own in enumerate(wrong):
            slope[outcome] = np.bincount(keys, weights=np.tile(own, FEATURES), minlength=buckets)
        self.scale += (slope * slope).mean(axis=0)
        self.weights -= np.float32(RATE) * slope / np.sqrt(self.scale)
        total = wrong.sum(axis=1).astype(np.float32)
        self.bias_scale += (total * total).mean()
        self.bias -= np.float32(RATE) * total / np.sqrt(self.bias_scale)
        self.met += np.bincount(keys, minlength=buckets)
        self.tokens += len(outcomes)


class Learner:
    """Gradient updates over the texts of one task, from shared weights."""

    def __init__(self, model: Model):
        self.layers = layers = Layers.of(model.weights, model.bias)
        self.groups = Softmax(layers.groups, layers.group_bias)
        self.members = [Softmax(layers.members[g], layers.member_bias[g]) for g in range(GROUPS)]

    def learn(self, features: np.ndarray, classes: np.ndarray) -> None:
        """Batches of all tokens for the groups, then of each group's tokens for its members."""
        group, member = classes // MEMBERS, classes % MEMBERS
        for a in range(0, len(classes), BATCH):
            self.groups.learn(features[a : a + BATCH], group[a : a + BATCH])
        for g, model in enumerate(self.members):
            at = np.flatnonzero(group == g)
            for a in range(0, len(at), BATCH):
                some = at[a : a + BATCH]
                model.learn(features[some], member[some])

    def learned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets that were met (the bias is -1), how often by each model, and the weights times that."""
        some = np.flatnonzero(self.groups.met)
        models = [self.groups, *self.members]
        met = np.stack([np.append(m.met[some], m.tokens) for m in models], axis=1)
        weights, bias = self.layers.joined()
        values = np.vstack([weights[some], bias])
        times = np.repeat(met, [GROUPS] + [MEMBERS] * GROUPS, axis=1)
        return np.append(some, -1), met, (values * times).astype(np.float32)


def learner_rows(model: Callable[[], Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, met, w): weights after the texts of a task, times how often each model met them; the bias is -1."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = model()
        task = Learner(shared)
        for batch in batches:
            for i, j in slices(batch.column(0), SLICE_BYTES):
                tokens = tokens_of(batch.column(0).slice(i, j - i), shared.counts, singles_only=True)
                task.learn(tokens.features, tokens.classes)
        if task.groups.tokens:
            bucket, met, values = task.learned()
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), lists(met), lists(values)], names=["bucket", "met", "w"]
            )

    return rows


def lists(values: np.ndarray) -> pa.Array:
    bounds = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(bounds, pa.array(values.ravel()))


def train(texts: DataFrame, counts: Counts, key: str = "key", rounds: int = ROUNDS) -> Model:
    """Weights from all texts (key, text): each round takes its share, by a hash of the key."""
    spark = texts.sparkSession
    model = Model(counts)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # bounded by buckets, classes and frequent words
        share = F.pmod(F.coalesce(F.xxhash64(key), F.lit(0)), F.lit(rounds)) == turn
        learned = texts.where(share).select("text").mapInArrow(
            learner_rows(lambda: sent.value), "bucket int, met array<bigint>, w array<float>"
        )
        part = [0] * GROUPS + [1 + i // MEMBERS for i in range(CLASSES)]  # the model that a weight belongs to
        met = [F.sum(F.col("met")[i]).alias(f"met{i}") for i in range(1 + GROUPS)]
        sums = [F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(WEIGHTS)]
        found = learned.groupBy("bucket").agg(*met, *sums)
        means = [
            F.when(F.col(f"met{part[i]}") > 0, F.col(f"w{i}") / F.col(f"met{part[i]}")).otherwise(F.lit(float("nan")))
            for i in range(WEIGHTS)
        ]
        with cleaned_up(spark):
            rows = found.select("bucket", F.array(*[m.cast("float") for m in means]).alias("w")).toArrow()
        sent.unpersist()  # workers hold what they were sent until then
        bucket = rows.column("bucket").to_numpy()
        values = rows.column("w").combine_chunks().flatten().to_numpy().reshape(len(bucket), WEIGHTS)
        weights, bias = model.weights.copy(), model.bias.copy()
        for own, value in ((weights, values[bucket >= 0]), (bias[None, :], values[bucket < 0])):
            at = bucket[bucket >= 0] if own is weights else np.zeros(len(value), dtype=np.int64)
            own[at] = np.where(np.isnan(value), own[at], value)
        model = Model(counts, weights, bias)
    return model


def frequent_words(table: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The words above a level of frequency that at most `HEAD_WORDS` reach, most frequent first.

    Levels are sixteenths of a doubling, so their list is short however many words there are.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = table.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    lowest, total = None, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        total += r.words
        if total > HEAD_WORDS:
            break
        lowest = r.level
    if lowest is None:
        return [], np.empty(0, dtype=np.int64)
    rows = table.where(level >= lowest).toArrow().combine_chunks()
    found = sorted(zip(rows.column("n").to_pylist(), rows.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    return [word for _, word in found], np.array([n for n, _ in found], dtype=np.int64)


def gather(texts: DataFrame) -> tuple[DataFrame, Counts]:
    """Counts of all words of the texts as a stored table, and what every task needs of them."""
    ship(texts.sparkSession)
    rows = texts.select("text").mapInArrow(count_words, WORD_COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
    table = durable(rows, "word-counts")
    ends = texts.count()
    total = table.agg(F.count("*").alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).collect()[0]
    values, n = frequent_words(table)
    single = np.full(len(n), -1, dtype=np.int64)
    single[: SINGLES - 1] = np.arange(1, SINGLES)[: len(n)]
    sizes = table.select("word", "n").mapInArrow(class_sizes, "class bigint, tokens bigint, words bigint")
    sizes = sizes.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        class_tokens[r["class"]], class_words[r["class"]] = r["tokens"], r["words"]
    hashes = np.empty(0, dtype=np.uint64)
    if len(n):
        data = np.frombuffer(b"".join(values), dtype=np.uint8)
        bounds = np.append(0, np.cumsum([len(w) for w in values]))
        hashes = word_hashes(Words(data, bounds, bounds[:-1], bounds[1:], bounds))
        own = suffix_class(data, bounds[:-1], bounds[1:])
        for i in range(min(SINGLES - 1, len(n))):
            class_tokens[own[i]] -= n[i]
            class_words[own[i]] -= 1
    order = np.argsort(hashes)
    return table, Counts(
        tokens=int(total.tokens) + ends,
        distinct=int(total.words) + (ends > 0),
        ends=ends,
        hashes=hashes[order],
        counts=n[order].astype(np.float64),
        single=single[order],
        class_tokens=class_tokens,
        class_words=class_words,
    )


SCORED = (
    "row bigint, key bigint, flag boolean, n_tokens bigint, n_known bigint, base double, score double, "
    "rare array<struct<word: binary, n: bigint>>"
)


def score_rows(model: Callable[[], Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over frequent words and ends per text, and its other words with their numbers.

    For the others everything but the logarithm of their counts is in the sums already.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        counts, layers = own.counts, Layers.of(own.weights, own.bias)
        base_share, class_share = counts.base_share(), counts.class_share()
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j in slices(batch.column(2), SLICE_BYTES):
                tokens = tokens_of(batch.column(2).slice(i, j - i), counts)
                n = j - i
                chosen = np.empty(len(tokens.classes))
                for a in range(0, len(chosen), SCORED_TOKENS):
                    b = a + SCORED_TOKENS
                    chosen[a:b] = layers.log_of(tokens.features[a:b], tokens.classes[a:b])
                known = tokens.head >= 0
                count = np.where(known, counts.counts[tokens.head] if len(counts.counts) else 0, 0)
                count = np.where(tokens.is_end, counts.ends, count)
                counted = known | tokens.is_end
                logged = np.where(counted, np.log10(count + 0.5), 0.0)
                inside = logged - class_share[tokens.classes]
                value = chosen / np.log(10) + np.where(tokens.classes < SINGLES, 0.0, inside)
                total = lambda x: np.bincount(tokens.text, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at + np.arange(n)),
                        batch.column(0).slice(i, n),
                        batch.column(1).slice(i, n),
                        pa.array(np.bincount(tokens.text, minlength=n)),
                        pa.array(total((counted & (count > 0)).astype(float)).astype(np.int64)),
                        pa.array(total(logged - base_share)),
                        pa.array(total(value)),
                        rare_words(tokens, ~counted, n),
                    ],
                    names=[part.split()[0] for part in SCORED.split(", ")][:8],
                )
                at += n

    return rows


def rare_words(tokens: Tokens, rare: np.ndarray, n: int) -> pa.Array:
    """For each text its words in `rare`, each once with its number."""
    words = tokens.words
    at = np.flatnonzero(rare[~tokens.is_end])
    text = words.text_of_word()[at]
    _, one, count = np.unique(
        mix(tokens.hashes[~tokens.is_end][at] + mix(text.astype(np.uint64))), return_index=True, return_counts=True
    )
    order = np.argsort(text[one], kind="stable")
    one, count = one[order], count[order]
    bounds = np.append(0, np.cumsum(np.bincount(text[one], minlength=n))).astype(np.int32)
    body = pa.StructArray.from_arrays(
        [spans(words.data, words.start[at[one]], words.end[at[one]]), pa.array(count.astype(np.int64))], names=["word", "n"]
    )
    return pa.ListArray.from_arrays(pa.array(bounds), body)


def score(docs: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """(key, flag, n_tokens, n_known, train_tokens, base, score) for rows (key, flag, text)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by buckets, classes and frequent words
    parts = docs.select("key", "flag", "text").mapInArrow(score_rows(lambda: sent.value), SCORED)
    parts = durable(parts, "scores")
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("n"))
    found = rare.join(table.withColumnRenamed("n", "count"), "word", "left")
    count = F.coalesce("count", F.lit(0))
    sums = found.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(count + 0.5)).alias("logs"),
        F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("known"),
    )
    rows = parts.drop("rare").join(sums, "row", "left")
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.select(
        "key",
        "flag",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        F.lit(model.counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base"),
        (F.col("score") + logs).alias("score"),
    )
