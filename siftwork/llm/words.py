"""Words of many texts at once, as positions in one buffer.

A word is a run of bytes other than space and the ASCII controls 9 to 13; bytes of UTF-8 characters
beyond ASCII never look like those, so splitting bytes equals splitting text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


@dataclass
class Words:
    """Words of some texts: their bytes, first and last positions, and where each text's words begin."""

    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # byte positions at which texts begin, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # for each text the number of words ahead of it, and the total

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def slices(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes of text; a longer text makes a range of its own."""
    sizes = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield begin, len(sizes)


def buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the positions between them; null is empty."""
    array = array.fill_null("") if array.null_count else array
    array = array.cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(array) or offsets[-1] == offsets[0]:
        return np.empty(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_words(array: pa.Array, lower: bool = False) -> Words:
    data, bounds = buffer(array)
    if lower:
        data = LOWER[data]
    return runs(data, bounds, SPACE)


def runs(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray) -> Words:
    """Runs of bytes that are not marked in `gap`, within each text."""
    if not len(data):
        empty = np.empty(0, dtype=np.int64)
        return Words(data, bounds, empty, empty, np.zeros(len(bounds), dtype=np.int64))
    space = gap[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = True
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    word = ~space
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


_powers: dict[str, np.ndarray] = {}


def powers(base: np.uint64, length: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < length:
        out = np.full(max(length, CHUNK_BYTES + 1), base, dtype=np.uint64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers[key][:length]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from differences of one running polynomial."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=running[1:])
    h = (running[end] - running[start]) * powers(BASE_INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of k neighbours at each position that has them; spans texts, so callers mask those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * BASE + hashes[j : j + n]
    return mix(out)


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept words, a space behind each: the bytes, where each word begins, and how many each text keeps."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    size = end - start + 1
    begin = np.cumsum(size) - size
    if not len(start):
        return np.empty(0, dtype=np.uint8), begin, np.zeros(len(words.first) - 1, dtype=np.int64)
    take = np.repeat(start - begin, size) + np.arange(int(size.sum()))
    out = words.data[np.minimum(take, len(words.data) - 1)]
    out[begin + size - 1] = 32
    text = words.text_of_word() if keep is None else words.text_of_word()[keep]
    return out, begin, np.bincount(text, minlength=len(words.first) - 1)
