"""Concatenate and cut: token ids of all documents, cut into windows of a fixed length.

The first pass writes each document's ids with its offset inside its partition. Prefix sums over the
partitions' token totals then give every document a global offset, and the second pass cuts it wherever a
window ends. Only partition totals, one row per partition, are gathered; texts are never shuffled.

Documents follow each other as they are scanned, or, where the caller names columns of file, split and row,
in the order of file names and of rows in each file. A task may hold splits of a file that do not touch.

A null or empty text is one end token. Repeated rows are packed once each. An empty table gives no pieces. A
text with its ids is handled whole in one task. The input may have any columns; those of `order` hold no nulls.
Tokenizers that do not look at each word alone get whole texts, so ids are those of the given file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.ship import durable, packed, ship
from siftwork.llm.words import LOWER, buffer, find_words, slices, span_hashes

LENGTH = 4096
END = 2
CACHE_WORDS = 1_500_000
STORED = "file string, lead bigint, at bigint, doc_id bigint, n bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)
#: Words of lower-case letters that one normaliser pass leaves as they are and one split keeps whole.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
SPECIAL = b"<|"
#: Totals of stretches up to this number of rows are sent to all executors, more are joined by shuffle.
STRETCHES = 100_000
#: The settings of a tokenizer under which ids can be looked up word by word.
WORD_BY_WORD = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_alphabet() -> dict[int, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


def word_by_word(path: str) -> bool:
    """Whether a tokenizer is known to look at each white-space separated word alone."""
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    plain = settings["model"].get("type") == "BPE" and not settings["model"].get("dropout")
    marked = all(token["content"].startswith(SPECIAL.decode()) for token in settings.get("added_tokens", []))
    return plain and marked and all(settings.get(name) == value for name, value in WORD_BY_WORD.items())


class Encoder:
    """Ids of texts by a tokenizer file.

    Where it looks at each white-space separated word alone, words that were seen before are looked up. The cache is
    bounded and only saves time. Other tokenizers are given whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = word_by_word(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.seen: dict[bytes, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if PLAIN.fullmatch(text):
            tokens = self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))
            ids = [token.id for token in tokens]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def texts(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        words = find_words(array) if self.by_word else None
        if words is None or SPECIAL in words.data.tobytes():  # strings of special tokens: as the tokenizer sees them
            parts = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in array.to_pylist()]
            flat = [i for part in parts for i in part]
            return np.array(flat, dtype=self.kind), np.array([len(p) for p in parts], dtype=np.int64)
        data, start, end = LOWER[words.data], words.start, words.end
        if not len(start):
            return np.empty(0, dtype=self.kind), np.zeros(len(array), dtype=np.int64)
        split = self.ends_with_mark(data, start, end)
        text = words.text_of_word()
        at = np.flatnonzero(split) + 1
        cut = end[at - 1] - 1
        end = np.insert(np.where(split, end - 1, end), at, cut + 1)
        start, text = np.insert(start, at, cut), np.insert(text, at, text[at - 1])
        _, one, each = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        raw, seen = data.tobytes(), self.seen
        if len(seen) > CACHE_WORDS:
            seen.clear()
        found = []
        for s, e in zip(start[one].tolist(), end[one].tolist()):
            key = raw[s:e]
            ids = seen.get(key)
            if ids is None:
                ids = seen[key] = self.word(key)
            found.append(ids)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(found), dtype=self.kind)
        begin, size = (np.cumsum(sizes) - sizes)[each], sizes[each]
        ahead = np.cumsum(size) - size
        ids = pool[np.repeat(begin - ahead, size) + np.arange(size.sum())]
        return ids, np.bincount(text, weights=size, minlength=len(array)).astype(np.int64)

    @staticmethod
    def ends_with_mark(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words that are a letter or more, and one full stop or comma, which is a token run of its own."""
        long = end - start >= 2
        last, before = data[end - 1], data[np.maximum(end - 2, start)]
        lead = data[np.maximum(end - 3, start)]
        plain = (before >= 97) & (before <= 122)
        accented = (end - start >= 3) & (lead == 0xC3) & (before >= 0x9F) & (before != 0xB7) & (before < 0xC0)
        return long & ((last == 46) | (last == 44)) & (plain | accented)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_rows(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of STORED for the (doc_id, text, file, split, row) of a partition.

    `at` counts the ids ahead in the same split of a file; `lead` is the first row of that stretch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, stretch, lead, total = encoder(path), None, 0, 0
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids, counts = work.texts(batch.column(1).slice(i, j - i))
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
                after = np.cumsum(counts)
                bounds = pa.py_buffer(np.append(0, after * work.kind.itemsize).astype(np.int64).tobytes())
                blob = pa.Array.from_buffers(
                    pa.large_binary(), len(counts), [None, bounds, pa.py_buffer(ids.tobytes())]
                )
                leads, ats = [], []
                places = zip(*[batch.column(c).slice(i, j - i).to_pylist() for c in (2, 3, 4)])
                for (file, split, row), n in zip(places, counts.tolist()):
                    if (file, split) != stretch:
                        stretch, lead, total = (file, split), row, 0
                    leads.append(lead)
                    ats.append(total)
                    total += n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(i, j - i),
                        pa.array(leads, pa.int64()),
                        pa.array(ats, pa.int64()),
                        batch.column(0).slice(i, j - i),
                        pa.array(counts),
                        blob.cast(pa.binary()),
                    ],
                    names=["file", "lead", "at", "doc_id", "n", "ids"],
                )

    return rows


def cut_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of PIECES for documents at global offsets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offset = batch.column(0).to_numpy()
            n = batch.column(2).to_numpy()
            raw, bounds = buffer(batch.column(3))
            width = int((bounds[-1] // max(1, n.sum()))) if len(n) else 2
            ids = np.frombuffer(raw.tobytes(), dtype=f"<u{width}").astype("<u4") if len(raw) else raw
            first = np.cumsum(n) - n
            pieces = (offset + n - 1) // length - offset // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            window = (offset // length)[row] + turn
            begin = np.maximum(window * length, offset[row])
            stop = np.minimum((window + 1) * length, (offset + n)[row])
            start = begin - offset[row]
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            low, high = (first[row] + start) * 4, (first[row] + start + stop - begin) * 4
            sums = [zlib.crc32(view[a:b]) for a, b in zip(low.tolist(), high.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(row)),
                    pa.array(start),
                    pa.array(stop - begin),
                    pa.array(np.array(sums, dtype=np.int64)),
                    pa.array(n[row]),
                    pa.array(window),
                    pa.array(begin - window * length),
                ],
                names=[field.split()[0] for field in PIECES.split(", ")],
            )

    return rows


def token_table(
    docs: DataFrame,
    tokenizer: str,
    end: int = END,
    key: str = "doc_id",
    text: str = "text",
    order: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Ids of each document, written once, with offsets inside each stretch of rows.

    `order` names columns of the file, the start of the split in it, and the row. Without it each scanned partition
    is a stretch.
    """
    ship(docs.sparkSession)
    part = F.spark_partition_id().cast("long")
    place = [F.lit("").alias("file"), F.lit(0).cast("long").alias("split"), part.alias("row")]
    if order:
        file, split, row = order
        place = [
            F.col(file).cast("string").alias("file"),
            F.col(split).cast("long").alias("split"),
            F.col(row).cast("long").alias("row"),
        ]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *place)
    return packed(rows.mapInArrow(token_rows(tokenizer, end), STORED), "tokens")


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces of the stored documents in windows of `length`; the last window may be shorter.

    Totals have one row per split of the first pass, which the driver schedules anyway. Up to STRETCHES of them are
    sent to all executors, so that ids stay where they are; beyond, they meet by shuffle.
    """
    totals = tokens.groupBy("file", "lead").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("file", "lead").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", "lead", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    base = durable(base, "stretches")
    placed = tokens.join(F.broadcast(base) if base.count() <= STRETCHES else base, ["file", "lead"])
    placed = placed.select((F.col("base") + F.col("at")).alias("offset"), "doc_id", "n", "ids")
    return placed.mapInArrow(cut_rows(length), PIECES)


def padded(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per sequence: its tokens, and its length after padding.

    A sequence is padded to the full length, unless its tokens are a power of two.
    """
    rows = cut.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return rows.withColumn("padded", F.when(power, F.col("tokens")).otherwise(F.lit(length)))


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, order: tuple[str, str, str] | None = None
) -> DataFrame:
    """All documents as pieces of windows."""
    return pieces(token_table(docs, tokenizer, order=order), length)
