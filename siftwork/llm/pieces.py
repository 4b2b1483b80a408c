"""SentencePiece BPE in vectorised merge rounds, and the way back from ids to text.

Texts become one flat array of characters, with a mark in front of each text and marks for spaces. It is cut
wherever two neighbouring characters stand side by side in no piece of the vocabulary: no merge can cross such
a place, so the spans between cuts, here called words, are independent and equal ones are encoded once. Then
rounds run over flat symbol arrays: the lowest pair rank of each word is found, its leftmost pairs that do not
overlap are merged at once, the arrays are compacted, and words without a pair drop out.

A round is exact, not close. Pairs of equal rank are merged together only while none of the pairs they would
create comes before them; behind one that does, the rest of its neighbourhood waits for the next round. In
long words the lowest rank counts within a neighbourhood as wide as the longest piece, which nothing outside
can reach before the pair itself is merged. A character whose runs are pieces of one score, worse than any
other (white space), is grouped last, from the left.

Null is an empty text: the end id alone. Repeated rows are encoded one by one. Very long texts are encoded
whole, in spans that end on cuts. An empty table gives no rows. Bytes that are not UTF-8 count as U+FFFD. The
input may have any columns; only the key and the text are read, a null key is kept. Models with another
normaliser, user-defined pieces or no byte fallback are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import ship
from siftwork.llm.words import BASE, buffer, slices, span_hashes

MARK = 0x2581
SPACE = 0x20
#: Rank of two neighbours that are no piece.
NEVER = np.int32(2**31 - 1)
#: Characters that are encoded at once; more of one text only behind the next cut.
SPAN_CHARS = 1 << 21
#: Words beyond this many symbols are merged by neighbourhood instead of by word.
LONG_WORD = 64


def utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def utf8_bytes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of characters, and how many each has."""
    size = utf8_sizes(points)
    which = np.repeat(np.arange(len(points)), size)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    value, of = points[which].astype(np.int64), size[which]
    tail = 0x80 | ((value >> (6 * (of - 1 - turn))) & 0x3F)
    lead = np.choose(of - 1, [value, 0xC0 | (value >> 6), 0xE0 | (value >> 12), 0xF0 | (value >> 18)])
    return np.where(turn == 0, lead, tail).astype(np.uint8), size


def code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, and the positions between texts."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
        ahead = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
        return points, ahead[bounds]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        return points, np.cumsum([0, *map(len, texts)])


def window_least(values: np.ndarray, left: int, right: int) -> np.ndarray:
    """The least value from `left` places ahead to `right` places behind."""
    padded = np.full(len(values) + left + right, NEVER, dtype=values.dtype)
    padded[left : left + len(values)] = values
    reach, width, out = left + right + 1, 1, padded
    while 2 * width <= reach:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    rest = reach - width
    return np.minimum(out[: len(values)], out[rest : rest + len(values)])


class Codec:
    """The vocabulary of a model as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if model.encode("ﬁ  a ", out_type=str) is None or model.normalize("ﬁ  Å ") != "▁ﬁ▁▁Å▁":
            raise ValueError("only models that do nothing to a text but mark its spaces and its begin")
        special = [i for i in range(size) if model.is_control(i) or model.is_unknown(i)]
        raw = [i for i in range(size) if model.is_byte(i)]
        if len(raw) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("only models with byte fallback and without unused pieces")
        self.bytes = np.zeros(256, dtype=np.int32)
        for i in raw:
            self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
        skip = set(special) | set(raw)
        self.pieces = {model.id_to_piece(i): i for i in range(size) if i not in skip}
        self.end = model.eos_id()
        self.reach = max(map(len, self.pieces))
        self._characters()
        self._pairs({i: model.get_score(i) for i in self.pieces.values()})
        self._surfaces(set(special), set(raw))

    def _characters(self) -> None:
        letters = sorted({c for piece in self.pieces for c in piece})
        self.letter = np.full(0x110000, -1, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        if any(c not in self.pieces for c in letters):
            raise ValueError("only models that have each character of a piece as a piece")
        self.piece_of_letter = np.array([self.pieces[c] for c in letters], dtype=np.int32)
        self.beside = np.zeros((len(letters), len(letters)), dtype=bool)
        for piece in self.pieces:
            at = self.letter[[ord(c) for c in piece]]
            self.beside[at[:-1], at[1:]] = True

    def _pairs(self, score: dict[int, float]) -> None:
        order = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
        found = {}
        for piece, i in self.pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.pieces.get(piece[:cut]), self.pieces.get(piece[cut:])
                if left is not None and right is not None:
                    found[(left << 32) | right] = (order[score[i]], i)
        self.runs = self._last_runs(score)
        keys = sorted(found)
        self.keys = np.array(keys, dtype=np.int64)
        self.ranks = np.array([found[k][0] for k in keys], dtype=np.int32)
        self.merged = np.array([found[k][1] for k in keys], dtype=np.int32)
        grouped = [i for c in self.runs for piece, i in self.pieces.items() if self.pieces[piece[0]] == c and set(piece) == {piece[0]}]
        self.ranks[np.isin(self.merged, grouped)] = NEVER
        self._table()

    def _last_runs(self, score: dict[int, float]) -> dict[int, list[list[int]]]:
        """For a character whose runs share the worst score, and that no other piece holds twice in a row: what
        a run of 0, 1, 2, ... of it becomes, up to the longest piece; longer runs begin with that piece.
        """
        worst = min(score.values())
        tied = {piece for piece, i in self.pieces.items() if score[i] == worst and len(piece) > 1}
        out = {}
        for c in {piece[0] for piece in tied}:
            held = {piece for piece in self.pieces if c + c in piece}
            if held != tied or any(set(piece) != {c} for piece in held):
                continue
            most = max(map(len, held))
            found = [self._run(c, n) for n in range(3 * most)]
            if all(found[n] == [self.pieces[c * most], *found[n - most]] for n in range(most, len(found))):
                out[self.pieces[c]] = found[:most] + [found[most]]
        return out

    def _run(self, c: str, n: int) -> list[int]:
        """The pieces of a run of one character, the leftmost pair that is a piece first."""
        parts, at = [c] * n, 0
        while at + 1 < len(parts):
            if parts[at] + parts[at + 1] in self.pieces:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = 0
            else:
                at += 1
        return [self.pieces[part] for part in parts]

    def _surfaces(self, special: set[int], raw: set[int]) -> None:
        model, parts = self.library, []
        for i in range(model.get_piece_size()):
            if i in raw:
                parts.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            elif i in special:
                parts.append(b"" if model.is_control(i) else model.decode([i]).encode())
            else:
                parts.append(model.id_to_piece(i).replace(chr(MARK), " ").encode())
        self.surface = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.surface_size = np.array([len(p) for p in parts], dtype=np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.control = np.array([i in special and model.is_control(i) for i in range(len(parts))])
        self.marked = np.array([i not in special and i not in raw and p[:1] == b" " for i, p in enumerate(parts)])

    def _table(self) -> None:
        """An open-addressed table of the pairs, so that many are looked up at once."""
        self.shift = np.uint64(64 - max(4, len(self.keys).bit_length() + 2))
        slots = 1 << (64 - int(self.shift))
        self.slot_key = np.full(slots, -1, dtype=np.int64)
        self.slot_pair = np.zeros(slots, dtype=np.int32)
        left, self.probes = np.arange(len(self.keys)), 0
        while len(left):
            slot = self._slot(self.keys[left], self.probes)
            free = np.flatnonzero(self.slot_key[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slot_key[slot[won]] = self.keys[left[won]]
            self.slot_pair[slot[won]] = left[won]
            left = np.delete(left, won)
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        spread = (keys.astype(np.uint64) * BASE) >> self.shift
        return ((spread + np.uint64(probe)) & np.uint64(len(self.slot_key) - 1)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of neighbours."""
        wanted = (left.astype(np.int64) << 32) | right
        rank, merged = np.full(len(wanted), NEVER, dtype=np.int32), np.full(len(wanted), -1, dtype=np.int32)
        rest = np.arange(len(wanted))
        for probe in range(self.probes):
            slot = self._slot(wanted[rest], probe)
            key = self.slot_key[slot]
            hit = key == wanted[rest]
            pair = self.slot_pair[slot[hit]]
            rank[rest[hit]], merged[rest[hit]] = self.ranks[pair], self.merged[pair]
            rest = rest[~hit & (key != -1)]
            if not len(rest):
                break
        return rank, merged

    def rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of words, given one after the other, until no pair remains.

        Returns the final symbols in the same order and the number of each word.
        """
        done, of = [], []
        number, first = np.arange(len(sizes)), np.cumsum(sizes) - sizes
        word = np.repeat(number, sizes)
        rank, merged = self.neighbours(symbols, word)
        while len(symbols):
            least = np.minimum.reduceat(rank, first)
            open_words = least < NEVER
            if not open_words.all():  # compaction: finished words leave the arrays
                keep = np.repeat(open_words, sizes)
                done.append(symbols[~keep])
                of.append(word[~keep])
                symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
                sizes, least = sizes[open_words], least[open_words]
                first = np.cumsum(sizes) - sizes
                if not len(symbols):
                    break
            bar, blocked = np.repeat(least, sizes), None
            long = sizes > LONG_WORD
            if long.any():
                wide = np.flatnonzero(np.repeat(long, sizes))
                bar[wide] = window_least(rank[wide], self.reach, self.reach)
                others = np.where(rank[wide] == bar[wide], NEVER, rank[wide])
                blocked = np.zeros(len(symbols), dtype=bool)
                blocked[wide] = window_least(others, self.reach, 0) <= rank[wide]
            at = np.flatnonzero((rank == bar) & (rank < NEVER))
            at = self.chosen(at, blocked, symbols, rank, merged, word)
            symbols, word, rank, merged, sizes = self.merge(at, symbols, word, rank, merged, sizes, first)
            first = np.cumsum(sizes) - sizes
        symbols, word = np.concatenate([*done, symbols]), np.concatenate([*of, word])
        order = np.argsort(word, kind="stable")
        symbols = symbols[order]
        return symbols, np.bincount(word, minlength=len(number)).astype(np.int64)

    def neighbours(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each symbol with the next one of its word."""
        rank = np.full(len(symbols), NEVER, dtype=np.int32)
        merged = np.full(len(symbols), -1, dtype=np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], merged[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return rank, merged

    def chosen(
        self,
        at: np.ndarray,
        blocked: np.ndarray | None,
        symbols: np.ndarray,
        rank: np.ndarray,
        merged: np.ndarray,
        word: np.ndarray,
    ) -> np.ndarray:
        """The leftmost of the pairs at these places that do not overlap and can be merged in one round.

        `blocked` marks places behind an equal pair that can't be merged yet.
        """
        if len(at) < 2:
            return at
        near = (word[at[1:]] == word[at[:-1]]) & (at[1:] - at[:-1] <= self.reach)
        if not near.any():
            return at if blocked is None else at[~blocked[at]]
        if blocked is None:
            blocked = np.zeros(len(symbols), dtype=bool)
        alone = np.append(True, ~((at[1:] == at[:-1] + 1) & near))  # begins a stretch of overlapping pairs
        begin = np.maximum.accumulate(np.where(alone, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - begin) % 2 == 0]
        near = (word[at[1:]] == word[at[:-1]]) & (at[1:] - at[:-1] <= self.reach)
        new, limit = merged[at], rank[at]
        last = len(symbols) - 1
        right = np.minimum(at + 2, last)
        after, _ = self.rank(new, symbols[right])
        bad = (after <= limit) & (at + 2 <= last) & (word[right] == word[at])
        left = np.maximum(at - 1, 0)
        before = symbols[left]
        touching = np.append(False, at[1:] - at[:-1] == 2)
        before[touching] = new[:-1][touching[1:]]
        ahead, _ = self.rank(before, new)
        bad |= (ahead <= limit) & (at > 0) & (word[left] == word[at])
        chain = np.cumsum(np.append(True, ~near))
        first = np.searchsorted(chain, chain)
        wrong = np.append(0, np.cumsum(bad))
        held = wrong[np.arange(len(at))] > wrong[first]  # behind one that goes first
        stuck = np.append(0, np.cumsum(blocked[at]))
        held |= stuck[1:] > stuck[first]
        return at[~held]

    def merge(
        self,
        at: np.ndarray,
        symbols: np.ndarray,
        word: np.ndarray,
        rank: np.ndarray,
        merged: np.ndarray,
        sizes: np.ndarray,
        first: np.ndarray,
    ) -> tuple[np.ndarray, ...]:
        """Merge the pairs at these places and rank the neighbours that this makes."""
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(sizes))
        at = at - np.arange(len(at))
        symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
        stale = np.concatenate([at, np.maximum(at - 1, 0)])
        rank[stale], merged[stale] = NEVER, -1
        stale = stale[stale < len(symbols) - 1]
        stale = stale[word[stale] == word[stale + 1]]
        rank[stale], merged[stale] = self.rank(symbols[stale], symbols[stale + 1])
        return symbols, word, rank, merged, sizes

    def grouped(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of a character that are grouped last, from the left, in pieces of the longest run."""
        for single, results in self.runs.items():
            is_run = symbols == single
            if not (is_run[1:] & is_run[:-1]).any():
                continue
            word = np.repeat(np.arange(len(sizes)), sizes)
            head = np.ones(len(symbols), dtype=bool)
            head[1:] = ~(is_run[1:] & is_run[:-1] & (word[1:] == word[:-1]))
            at = np.flatnonzero(head)
            length = np.diff(np.append(at, len(symbols)))
            length[~is_run[at]] = 0
            most = len(results) - 1
            full, rest = length // most, length % most
            tail_size = np.array([len(r) for r in results], dtype=np.int64)
            tails = np.array([i for r in results for i in r], dtype=np.int32)
            pool = np.concatenate([tails, np.array(results[most], dtype=np.int32), symbols])
            tail_at = np.cumsum(tail_size) - tail_size
            plain = ~is_run[at]
            # each head gives its full pieces, then its tail or itself
            counts = np.stack([full, np.where(plain, 1, tail_size[rest])], axis=1).ravel()
            source = np.stack([np.full(len(at), len(tails)), np.where(plain, len(tails) + 1 + at, tail_at[rest])], axis=1).ravel()
            repeated = np.repeat(np.arange(len(counts)) % 2 == 0, counts)
            take = np.where(repeated, len(tails), spans(source, counts))
            sizes = np.bincount(np.repeat(word[at], counts.reshape(-1, 2).sum(axis=1)), minlength=len(sizes)).astype(np.int64)
            symbols = pool[take]
        return symbols, sizes

    def cuts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places at which words begin: texts' begins, and between characters that no piece has side by side."""
        letter = self.letter[points]
        known = (letter[:-1] >= 0) & (letter[1:] >= 0)
        begins = np.ones(len(points), dtype=bool)
        begins[1:] = ~(known & self.beside[letter[:-1], letter[1:]])
        begins[bounds[:-1][bounds[:-1] < len(points)]] = True
        return np.flatnonzero(begins)

    def words(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of known characters, one after the other, and the number of ids of each."""
        symbols, sizes = self.rounds(self.piece_of_letter[self.letter[points]], sizes)
        return self.grouped(symbols, sizes)

    def span(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spans of marked texts in one array, and the number of ids of each span."""
        if not len(points):
            return np.empty(0, dtype=np.int32), np.zeros(len(bounds) - 1, dtype=np.int64)
        start = self.cuts(points, bounds)
        end = np.append(start[1:], len(points))
        _, one, each = np.unique(span_hashes(points, start, end), return_index=True, return_inverse=True)
        if not same_spans(points, start, end, one[each]):  # two words of one hash: encode each by itself
            one = each = np.arange(len(start))
        begin, stop = start[one], end[one]
        known = self.letter[points[begin]] >= 0  # other characters are words of their own
        size = stop - begin
        ids, sizes = self.words(points[spans(begin[known], size[known])], size[known])
        raw, raw_sizes = utf8_bytes(points[begin[~known]])
        pool = np.concatenate([ids, self.bytes[raw]])
        counts, base = np.empty(len(one), dtype=np.int64), np.empty(len(one), dtype=np.int64)
        counts[known], counts[~known] = sizes, raw_sizes
        base[known], base[~known] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(raw_sizes) - raw_sizes
        out = pool[spans(base[each], counts[each])]
        ahead = np.append(0, np.cumsum(counts[each]))
        return out, np.diff(ahead[np.searchsorted(start, bounds)])

    def texts(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without the end id, in one array, and the number of ids of each text."""
        points, bounds = code_points(*buffer(array))
        points = np.where(points == SPACE, np.uint32(MARK), points).astype(np.uint32)
        filled = np.diff(bounds) > 0
        points = np.insert(points, bounds[:-1][filled], MARK)
        bounds = bounds + np.append(0, np.cumsum(filled))
        parts, counts, text, at = [], [], 0, 0
        total = np.zeros(len(array), dtype=np.int64)
        while at < len(points) or text < len(array):
            stop = min(at + SPAN_CHARS, len(points))
            while 0 < stop < len(points):  # go on to the next cut
                ahead = self.cuts(points[stop - 1 : stop + SPAN_CHARS], np.array([0, 0]))
                ahead = ahead[ahead > 0]
                if len(ahead):
                    stop = stop - 1 + int(ahead[0])
                    break
                stop = min(stop + SPAN_CHARS, len(points))
            last = int(np.searchsorted(bounds, stop, side="left")) if stop < len(points) else len(array)
            inner = np.clip(bounds[text : last + 1], at, stop)
            ids, counts = self.span(points[at:stop], inner - at)
            parts.append(ids)
            total[text:last] += counts
            text, at = (last if stop == len(points) or bounds[last] == stop else last - 1), stop
        return np.concatenate([*parts, np.empty(0, dtype=np.int32)]), total

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of lists of ids, given one after the other."""
        number = np.repeat(np.arange(len(sizes)), sizes)
        shown = np.flatnonzero(~self.control[ids])
        lead = shown[np.append(True, number[shown][1:] != number[shown][:-1])] if len(shown) else shown
        strip = np.zeros(len(ids), dtype=np.int64)
        strip[lead] = self.marked[ids[lead]]  # the mark in front of each text
        size = self.surface_size[ids] - strip
        data = self.surface[spans(self.surface_at[ids] + strip, size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(sizes))].tolist()
        out, at = [], np.append(0, np.cumsum(sizes))
        for n, (a, b) in enumerate(zip(ends, ends[1:])):
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:  # byte ids that no text gives
                out.append(self.library.decode(ids[at[n] : at[n + 1]].tolist()))
        return out


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of spans, one span after the other."""
    ahead = np.cumsum(size) - size
    return np.repeat(begin - ahead, size) + np.arange(int(size.sum()))


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span equals the span whose number is given beside it."""
    size = end - start
    if (size != size[other]).any():
        return False
    differ = np.flatnonzero(other != np.arange(len(start)))
    a, b = spans(start[differ], size[differ]), spans(start[other[differ]], size[differ])
    return bool((data[a] == data[b]).all())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def list_array(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))


def id_rows(path: str, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, ids) or (key, ids, decoded text) of (key, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(path)
        for batch in batches:
            for i, j in slices(batch.column(1)):
                ids, sizes = work.texts(batch.column(1).slice(i, j - i))
                ids = np.insert(ids, np.cumsum(sizes), work.end)
                sizes = sizes + 1
                columns = [batch.column(0).slice(i, j - i), list_array(ids, sizes)]
                if decoded:
                    columns.append(pa.array(work.decode(ids, sizes), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

    return rows


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """`key` and `ids` of each row, the end id included; with `decoded` also the text that the ids give.

    One pass over the texts, no shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + (", decoded string" if decoded else "")
    return rows.mapInArrow(id_rows(model, decoded), schema)


def decode(ids: str, model: str) -> Column:
    """The text of a column of ids; null for null."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = codec(model)
        for batch in batches:
            sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = work.decode(batch.flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.array([t if ok else None for t, ok in zip(found, batch.is_valid().to_pylist())], pa.string())

    return text(F.col(ids))
