"""Language spans of mixed texts.

Each word is scored per language by byte trigrams, edges included, of counts learned from labelled texts.
The scripts of its letters, found by code point ranges, leave only languages that use them. A Viterbi search
over the words of a text, with a penalty for each switch, gives spans of one language each; the language
with most letters is the text's. Words without a letter fit any language.

The classifier is fitted on a bounded sample: about `PER_LANGUAGE` labelled texts of each language, chosen
by a hash of the key. Null texts and texts without a letter are `und` with score zero, as is everything when
nothing is labelled. Repeated rows get equal results; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import ship
from siftwork.llm.words import BASE, LOWER, SPACE, Words, find_words, slices

PER_LANGUAGE = 2000
BUCKET_BITS = 16
SWITCH = 14.0
FOREIGN = 30.0
SHARE_OF_SCRIPT = 0.005
UNKNOWN = "und"
#: First and last code points of blocks of some scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("ethiopic", ((0x1200, 0x137F),)),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF))),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
)
SPANS = "array<struct<begin: int, end: int, lang: string>>"

_letters: list[np.ndarray] = []


def letter_scripts() -> np.ndarray:
    """For each code point zero, or for a letter a bit of its script (the highest one: some other script)."""
    if not _letters:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        bits = np.full(0x110000, 1 << len(SCRIPTS), dtype=np.int32)
        for i, (_, ranges) in enumerate(SCRIPTS):
            for low, high in ranges:
                bits[low : high + 1] = 1 << i
        _letters.append(np.where(letter, bits, 0).astype(np.int32))
    return _letters[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of first bytes and the code points that begin there."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    length = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(length == 1, lead, lead & (0xFF >> (length + 1)))
    last = len(data) - 1
    for j in range(1, 4):
        more = length > j
        point[more] = (point[more] << 6) | (data[np.minimum(at[more] + j, last)] & 0x3F)
    return at, np.minimum(point, 0x10FFFF)


def word_letters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the bits of their scripts."""
    if not len(words.start):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)
    at, points = code_points(words.data)
    scripts = letter_scripts()[points]
    count = np.zeros(len(at) + 1, dtype=np.int64)
    np.cumsum(scripts > 0, out=count[1:])
    low, high = np.searchsorted(at, words.start), np.searchsorted(at, words.end)
    return count[high] - count[low], np.bitwise_or.reduceat(scripts, low)


def trigram_buckets(words: Words) -> np.ndarray:
    """The hashed trigram around each byte; white space of any kind and text ends are blanks."""
    low = np.where(SPACE[words.data], np.uint8(32), LOWER[words.data]).astype(np.uint64)
    before, after = np.empty_like(low), np.empty_like(low)
    before[0], before[1:] = 32, low[:-1]
    after[-1], after[:-1] = 32, low[1:]
    inner = words.bounds[1:-1]
    before[inner[inner < len(low)]] = 32
    after[inner[inner > 0] - 1] = 32
    key = (before << np.uint64(16)) | (low << np.uint64(8)) | after
    return ((key * BASE) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    """Languages by name, log probabilities per bucket and language, and scripts of each as bits."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray

    def emissions(self, words: Words, scripts: np.ndarray) -> np.ndarray:
        """One row per word: how much worse each language is than the best."""
        buckets = trigram_buckets(words)
        out = np.zeros((len(words.start), len(self.languages)), dtype=np.float32)
        for i in range(len(self.languages)):
            total = np.zeros(len(buckets) + 1)
            np.cumsum(self.weights[buckets, i], out=total[1:])
            out[:, i] = total[words.end] - total[words.start]
        fits = (scripts[:, None] & self.scripts[None, :]) != 0
        out -= np.where(fits | ~fits.any(axis=1)[:, None], 0, FOREIGN).astype(np.float32)
        out[scripts == 0] = 0
        return out - out.max(axis=1)[:, None]


def best_paths(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The state of each word on the best path of its text; texts advance together, longest ones first."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, ranked = first[:-1][order], counts[order]
    n, states = scores.shape
    stay = np.empty((n, states), dtype=bool)
    top = np.zeros(n, dtype=np.int16)
    value = np.zeros((len(order), states), dtype=np.float32)
    steps = int(ranked[0]) if len(ranked) else 0
    active = np.searchsorted(-ranked, -np.arange(steps), side="left")  # texts with more words than t
    for t in range(steps):
        k = active[t]
        at = begin[:k] + t
        v = value[:k]
        best = v.max(axis=1)[:, None] - np.float32(switch if t else 0)
        top[at] = v.argmax(axis=1)
        stay[at] = v >= best
        np.maximum(v, best, out=v)
        v += scores[at]
        v -= v.max(axis=1)[:, None]
    path = np.zeros(n, dtype=np.int16)
    state = value.argmax(axis=1) if states else np.zeros(len(order), dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        own = state[:k]
        path[at] = own
        state[:k] = np.where(stay[at, own], own, top[at])
    return path


def label(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Language, score and spans (in words) of each text."""
    words = find_words(texts)
    n, names = len(texts), model.languages
    letters, scripts = word_letters(words)
    if not names or not len(letters):
        return [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    path = best_paths(model.emissions(words, scripts), words.first)
    text = words.text_of_word()
    mass = np.zeros((n, len(names)))
    np.add.at(mass, (text, path), letters)
    total = mass.sum(axis=1)
    best = mass.argmax(axis=1)
    score = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
    opens = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
    closes = np.append(opens[1:], len(text))
    spans: list[list[dict]] = [[] for _ in range(n)]
    for a, b in zip(opens.tolist(), closes.tolist()):
        i = text[a]
        if total[i]:
            ahead = int(words.first[i])
            spans[i].append({"begin": a - ahead, "end": b - ahead, "lang": names[path[a]]})
    return [names[b] if t else UNKNOWN for b, t in zip(best, total)], score, spans


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n): trigrams of words with a letter; words by script under negative buckets."""
    for batch in batches:
        for i, j in slices(batch.column(1)):
            words = find_words(batch.column(1).slice(i, j - i))
            if not len(words.start):
                continue
            langs = batch.column(0).slice(i, j - i).to_pylist()
            names = sorted(set(langs))
            own = np.array([names.index(x) for x in langs])
            letters, scripts = word_letters(words)
            size = words.end - words.start
            inside = np.repeat(letters > 0, size)
            spot = np.repeat(words.start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            word_lang = own[words.text_of_word()]
            keys = np.repeat(word_lang, size)[inside] << BUCKET_BITS | trigram_buckets(words)[spot[inside]]
            found, n = np.unique(keys, return_counts=True)
            lang, bucket = found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1)
            for s in range(len(SCRIPTS) + 1):
                each = np.bincount(word_lang[(scripts >> s & 1) > 0], minlength=len(names))
                lang = np.append(lang, np.arange(len(names)))
                bucket, n = np.append(bucket, np.full(len(names), -1 - s)), np.append(n, each)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[x] for x in lang]), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["lang", "bucket", "n"],
            )


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (key, text, lang) rows without null; what comes to the driver is bounded by the buckets."""
    ship(labelled.sparkSession)
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("total"))
    scale = 1 << 30
    chance = F.xxhash64("key").bitwiseAND(F.lit(scale - 1)).cast("double") * F.col("total") / scale
    sample = labelled.join(F.broadcast(sizes), "lang").where(chance < per_language)  # one row per language
    counted = sample.select("lang", "text").mapInArrow(count_rows, "lang string, bucket int, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    counts = np.full((1 << BUCKET_BITS, len(names)), 0.5)
    by_script = np.zeros((len(SCRIPTS) + 1, len(names)))
    place = rows["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    gram = bucket >= 0
    counts[bucket[gram], place[gram]] += n[gram]
    by_script[-1 - bucket[~gram], place[~gram]] = n[~gram]
    used = by_script >= SHARE_OF_SCRIPT * np.maximum(by_script.sum(axis=0), 1)
    bits = (used * (1 << np.arange(len(SCRIPTS) + 1))[:, None]).sum(axis=0).astype(np.int32)
    return Model(names, np.log(counts / counts.sum(axis=0)).astype(np.float32), bits)


def labeller(model: Callable[[], Model]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model()
        for batch in batches:
            langs, scores, spans = [], [], []
            for i, j in slices(batch):
                lang, score, span = label(own, batch.slice(i, j - i))
                langs += lang
                scores += score.tolist()
                spans += span
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)]
            yield pa.StructArray.from_arrays(columns, names=["lang", "score", "spans"])

    return compute


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """struct<lang, score, spans> of a text column."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by buckets and languages
    kind = f"struct<lang: string, score: double, spans: {SPANS}>"
    return F.arrow_udf(labeller(lambda: sent.value), kind)(F.col(text).cast("string"))
