"""Repeated passages by sharded Aho-Corasick automata.

A window is 20 neighbouring words. Equal windows have equal smallest hashes among their 8-word grams, so only
windows whose smallest gram (their anchor) occurs elsewhere too can recur. Runs of such windows are cut from
the texts and collapse to distinct ones with their first place and number. Their windows are dealt to shards
by the anchor; each shard confirms the windows that recur, compiles them into an automaton over words and
streams its texts through it, which finds every occurrence and with it the first one. Occurrences other than
the first cover the words that go.

Windows under an anchor with very many occurrences are runs of their own, one row per text with all places
in it: equal ones collapse before any shard sees them, and the others are dealt out by their content, so no
shard grows with one passage.

Null texts have no words. Rows that share a doc_id but not the text are told apart by a hash of the text;
windows that begin at the same place of such rows both stay. Null doc_ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import durable, packed, ship
from siftwork.llm.words import Words, find_words, gram_hashes, joined, mix, slices, word_hashes

WINDOW = 20
ANCHOR = 8
HOT = 10_000
SHARD_WORDS = 100_000
SECOND_LETTERS = 256
RUNS = "run binary, doc_id bigint, mark bigint, starts array<int>, n_words int, parts int, words binary"
SEGMENTS = (
    "shard int, run binary, at int, windows int, n bigint, first_doc bigint, first_start int, words binary"
)
COVERS = "run binary, first_doc bigint, first_start int, begin int, stop int, always boolean"


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each stretch of windows with one anchor."""
    n = len(words.start) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.int64),)
    grams = gram_hashes(word_hashes(words), ANCHOR)
    best, place, width = grams, np.arange(len(grams)), 1  # the first smallest gram of `width` neighbours
    while width < WINDOW - ANCHOR + 1:
        step = min(width, WINDOW - ANCHOR + 1 - width)
        lower = best[step:] < best[:-step]
        place = np.where(lower, place[step:], place[:-step])
        best, width = np.minimum(best[step:], best[:-step]), width + step
    text = words.text_of_word()
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    if not len(at):
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.int64),)
    opens = np.flatnonzero((np.diff(place[at], prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    return at[opens], np.diff(np.append(opens, len(at))), best[at[opens]].view(np.int64)


def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n) of texts, summed over some megabytes at a time."""
    for batch in batches:
        for i, j in slices(batch.column(0)):
            _, _, anchors = segments(find_words(batch.column(0).slice(i, j - i)))
            found, n = np.unique(anchors, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["anchor", "n"])


def document_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id), each once per text."""
    for batch in batches:
        for i, j in slices(batch.column(1)):
            words = find_words(batch.column(1).slice(i, j - i))
            start, _, anchors = segments(words)
            text = words.text_of_word()[start] if len(start) else start
            _, one = np.unique(mix(anchors.view(np.uint64) ^ mix(text.astype(np.uint64))), return_index=True)
            ids = batch.column(0).slice(i, j - i).take(pa.array(text[one]))
            yield pa.RecordBatch.from_arrays([pa.array(anchors[one]), ids], names=["anchor", "doc_id"])


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS from (doc_id, text, anchors, parts): stretches of windows with recurring anchors."""
    for batch in batches:
        for i, j in slices(batch.column(1)):
            yield runs_of(batch.slice(i, j - i))


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def runs_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = find_words(batch.column(1))
    start, size, anchors = segments(words)
    known, owner = flat_lists(batch.column(2))
    parts = flat_lists(batch.column(3))[0]
    keys = mix(known.astype(np.int64).view(np.uint64) ^ mix(owner.astype(np.uint64)))
    order = np.argsort(keys)
    keys, parts = keys[order], parts[order]
    text = words.text_of_word()[start] if len(start) else start
    mine = mix(anchors.view(np.uint64) ^ mix(text.astype(np.uint64)))
    spot = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
    hit = keys[spot] == mine if len(keys) else np.zeros(len(mine), dtype=bool)
    start, size, text, parts = start[hit], size[hit], text[hit], (parts[spot[hit]] if len(keys) else spot[hit])
    single = np.repeat(parts > 1, np.where(parts > 1, size, 1))  # windows of hot anchors one by one
    times = np.where(parts > 1, size, 1)
    ahead = np.arange(len(single)) - np.repeat(np.cumsum(times) - times, times)
    start, text = np.repeat(start, times) + ahead, np.repeat(text, times)
    size, parts = np.where(single, 1, np.repeat(size, times)), np.repeat(parts, times)
    opens = np.ones(len(start), dtype=bool)
    if len(start):
        follows = (start[1:] == start[:-1] + size[:-1]) & (text[1:] == text[:-1])
        opens[1:] = ~follows | single[1:] | single[:-1]
    first = np.flatnonzero(opens)
    begin = start[first]
    n_words = (np.add.reduceat(size, first) if len(first) else size) + WINDOW - 1
    body, place, _ = joined(words)
    raw, place = body.tobytes(), np.append(place, len(body))
    low, high = place[begin], place[begin + n_words] - 1
    pieces = [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]
    owner, parts = text[first], parts[first]
    begin = begin - words.first[:-1][owner]
    rows, starts, known_at = [], [], {}
    for k, (piece, text_of, at, hot) in enumerate(zip(pieces, owner.tolist(), begin.tolist(), (parts > 1).tolist())):
        row = known_at.setdefault((text_of, piece), len(rows)) if hot else len(rows)
        if row < len(rows):
            starts[row].append(at)
        else:
            rows.append(k)
            starts.append([at])
    marks = [signed(xxhash.xxh64_intdigest(t or "", 42)) for t in batch.column(1).to_pylist()]
    owner = owner[rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([xxhash.xxh3_128_digest(pieces[k]) for k in rows], pa.binary()),
            batch.column(0).take(pa.array(owner, pa.int64())),
            pa.array(np.array(marks, dtype=np.int64)[owner]),
            pa.array(starts, pa.list_(pa.int32())),
            pa.array(n_words[rows].astype(np.int32)),
            pa.array(parts[rows].astype(np.int32)),
            pa.array([pieces[k] for k in rows], pa.binary()),
        ],
        names=[part.split()[0] for part in RUNS.split(", ")],
    )


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def segment_rows(shards: int):
    """Rows of SEGMENTS from distinct runs (run, n, first, parts, words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(5)):
                part = batch.slice(i, j - i)
                words = find_words(part.column(5).cast(pa.string()))
                start, size, anchors = segments(words)
                owner = words.text_of_word()[start] if len(start) else start
                salt = np.array([xxhash.xxh64_intdigest(r) for r in part.column(0).to_pylist()], dtype=np.uint64)
                hot = part.column(4).to_numpy() > 1
                key = anchors.view(np.uint64) ^ np.where(hot, salt, np.uint64(0))[owner]
                body, place, _ = joined(words)
                raw, place = body.tobytes(), np.append(place, len(body))
                low, high = place[start], place[start + size + WINDOW - 1] - 1
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((mix(key) % np.uint64(shards)).astype(np.int32)),
                        part.column(0).take(take),
                        pa.array((start - words.first[:-1][owner]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        part.column(1).take(take),
                        part.column(2).take(take),
                        part.column(3).take(take),
                        pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary()),
                    ],
                    names=[x.split()[0] for x in SEGMENTS.split(", ")],
                )

    return rows


def letter(number: int) -> str:
    """A character for a word of a shard; the range that isn't text is left out."""
    return chr(number if number < 0xD800 else number + 0x800)


class Letters(dict):
    """Two letters for each word of a shard, given when it is first asked for.

    A node of an automaton looks through its children one by one, so an alphabet of all words would make the
    root slow. First and second letters differ, so no match begins or ends inside a word.
    """

    def __missing__(self, word: bytes) -> str:
        high, low = divmod(len(self), SECOND_LETTERS)
        self[word] = out = letter(1 + SECOND_LETTERS + high) + letter(1 + low)
        return out


def locate(shard: pa.Table) -> pa.Table:
    """Rows of COVERS for the segments of one shard.

    Words are pairs of letters of the shard's own alphabet, so a window is a string of 40. Equal segments are
    streamed once, at their first place. Windows that occur once are left out of the automaton; what it
    finds are all occurrences of all others.
    """
    import ahocorasick

    numbers = shard.column("n").to_pylist()
    docs = shard.column("first_doc").to_pylist()
    starts = pc.add(shard.column("first_start").cast(pa.int64()), shard.column("at").cast(pa.int64())).to_pylist()
    # the place of each segment's first word as one number; a null document comes before all others
    places = [s if d is None else ((d + (1 << 63) + 1) << 32) + s for d, s in zip(docs, starts)]
    rows_of: dict[bytes, list[int]] = {}
    for k, raw in enumerate(shard.column("words").to_pylist()):
        if raw in rows_of:
            rows_of[raw].append(k)
        else:
            rows_of[raw] = [k]
    alphabet = Letters()
    texts = ["".join([alphabet[word] for word in raw.split(b" ")]) for raw in rows_of]
    del alphabet
    groups = list(rows_of.values())
    seen: dict[str, bool] = {}  # whether a window occurs twice or more
    for text, rows in zip(texts, groups):
        again = len(rows) > 1 or numbers[rows[0]] > 1
        for end in range(2 * WINDOW, len(text) + 1, 2):
            window = text[end - 2 * WINDOW : end]
            seen[window] = again or window in seen
    automaton = ahocorasick.Automaton()
    total = 0
    for window, again in seen.items():
        if again:
            automaton.add_word(window, total)
            total += 1
    del seen
    taken, begins, stops, kinds = [], [], [], []

    def cover(k: int, ranges: list[tuple[int, int]], always: bool) -> None:
        for begin, stop in ranges:
            taken.append(k)
            begins.append(begin)
            stops.append(stop)
            kinds.append(always)

    if total:
        automaton.make_automaton()
        first: list = [None] * total
        hits = []
        heads = [rows[0] if len(rows) == 1 else min(rows, key=places.__getitem__) for rows in groups]
        for text, head in zip(texts, heads):
            hits.append(found := [(end >> 1, phrase) for end, phrase in automaton.iter(text)])
            base = places[head] - WINDOW + 1
            for end, phrase in found:
                if (now := first[phrase]) is None or base + end < now:
                    first[phrase] = base + end
        for found, rows, head in zip(hits, groups, heads):
            if not found:
                continue
            place = places[head]
            base = place - WINDOW + 1
            late = stretches([end - WINDOW + 1 for end, phrase in found if first[phrase] != base + end])
            every = stretches([end - WINDOW + 1 for end, _ in found]) if len(rows) > 1 else []
            early = None
            for k in rows:
                if places[k] != place:  # behind the first place of an equal segment
                    cover(k, every, True)
                    continue
                cover(k, late, True)
                if numbers[k] > 1:
                    if early is None:
                        early = stretches([end - WINDOW + 1 for end, phrase in found if first[phrase] == base + end])
                    cover(k, early, False)
    rows = pa.array(taken, pa.int64())
    ats = shard.column("at").take(rows)
    columns = [shard.column(name).take(rows) for name in ("run", "first_doc", "first_start")]
    columns += [pc.add(ats, pa.array(x, pa.int32())) for x in (begins, stops)]
    return pa.Table.from_arrays([*columns, pa.array(kinds, pa.bool_())], names=[part.split()[0] for part in COVERS.split(", ")])


def stretches(numbers: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as half-open ranges."""
    out: list[tuple[int, int]] = []
    for x in numbers:
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): word ranges of each text of (doc_id, text) that repeat an earlier passage."""
    spark = docs.sparkSession
    ship(spark)
    counted = docs.select("text").mapInArrow(count_anchors, "anchor bigint, n bigint")
    counted = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    anchors = durable(counted.select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "anchors")
    held = docs.select("doc_id", "text").mapInArrow(document_anchors, "anchor bigint, doc_id bigint")
    hits = held.join(anchors, "anchor").groupBy("doc_id")
    hits = hits.agg(F.collect_list(F.struct("anchor", "parts")).alias("hit"))
    hits = durable(hits.select("doc_id", F.col("hit.anchor").alias("anchors"), F.col("hit.parts").alias("parts")), "hits")
    own = hits.withColumnRenamed("doc_id", "own")
    met = docs.select("doc_id", "text").join(own, F.col("doc_id").eqNullSafe(F.col("own")))
    runs = packed(met.select("doc_id", "text", "anchors", "parts").mapInArrow(run_rows, RUNS), "runs")
    total = runs.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).collect()[0].n
    distinct = runs.groupBy("run").agg(
        F.sum(F.size("starts")).alias("n"),
        F.min(F.struct("doc_id", F.col("starts")[0].alias("start"))).alias("first"),
        F.max("parts").alias("parts"),
        F.min("words").alias("words"),
    )
    distinct = distinct.select("run", "n", "first.doc_id", "first.start", "parts", "words")
    dealt = distinct.mapInArrow(segment_rows(1 + int(total) // SHARD_WORDS), SEGMENTS)
    covers = durable(dealt.groupBy("shard").applyInArrow(locate, COVERS), "covers")
    found = runs.select("run", "doc_id", "mark", "starts").join(covers, "run")
    spans = F.expr(
        f"""transform(filter(starts, s -> always or not (doc_id <=> first_doc) or s != first_start),
            s -> struct(s + begin as begin, s + stop + {WINDOW - 1} as stop))"""
    )
    found = found.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list(spans)).alias("spans"))
    return durable(found, "repeated-spans")


def keep_rest(texts: pa.Array, spans: pa.Array) -> pa.StructArray:
    """n_words, n_removed and the kept words, joined by one space, of texts less their spans of words."""
    words = find_words(texts)
    n = len(texts)
    edges = np.zeros(len(words.start) + n + 1, dtype=np.int64)  # one place more for each text
    sizes = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), sizes)
    flat = spans.drop_null().flatten()
    base = words.first[:-1] + np.arange(n)
    np.add.at(edges, base[owner] + flat.field("begin").to_numpy(zero_copy_only=False), 1)
    np.add.at(edges, base[owner] + flat.field("stop").to_numpy(zero_copy_only=False), -1)
    covered = np.cumsum(edges)
    keep = covered[np.arange(len(words.start)) + words.text_of_word()] == 0
    body, _, counts = joined(words, keep)
    size = np.bincount(words.text_of_word()[keep], weights=(words.end - words.start)[keep] + 1, minlength=n)
    bounds = np.append(0, np.cumsum(size.astype(np.int64)))
    raw = body.tobytes()
    kept = [raw[a : max(a, b - 1)].decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    total = words.counts()
    return pa.StructArray.from_arrays(
        [pa.array(total), pa.array(total - counts), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"]
    )


def kept(text: str, spans: str) -> Column:
    """struct<n_words, n_removed, kept> of a text column and its spans."""

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept: string>")
    def compute(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            parts = [keep_rest(texts.slice(i, j - i), ranges.slice(i, j - i)) for i, j in slices(texts)]
            kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return compute(F.col(text), F.col(spans))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the kept words of its text."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = repeated_spans(rows).toDF("own", "own_mark", "spans")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("mark", mark)
    same = rows["doc_id"].eqNullSafe(found["own"]) & (rows["mark"] == found["own_mark"])
    judged = rows.join(found, same, "left").select("doc_id", kept("text", "spans").alias("k"))
    return judged.select("doc_id", "k.n_words", "k.n_removed", "k.kept")
