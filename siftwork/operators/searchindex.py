"""A stored index for regular expressions: which texts hold which three characters in a row.

Texts are indexed in segments of consecutive rows. Per segment and trigram there is one posting: the rows that
hold it, as 16-bit places or as a bitmap, whichever is shorter. Postings lie in the order of trigrams, so a search
reads those of a few trigrams; they meet per segment, where the places of all needed trigrams are intersected.

A search takes from its pattern the literals that every match needs. Rows with all trigrams of these are
candidates, and the pattern decides on their texts alone. A pattern that needs no literal of three characters
is looked for in every text.

Trigrams are of printable ASCII, folded as matching without case does: capitals, the Kelvin sign, the long s
and the i with and without its dot count as what they match. Other characters are in no trigram and the pattern
alone decides on them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.textindex import in_ranges
from siftwork.sources.durable import new_path, shared_folder
from siftwork.sources.manifest import files_digest, files_of, remembered

#: Rows of a segment, whose places fit 16 bits, and the bytes of text in it: a worker holds one segment at a time.
SEGMENT_ROWS = 1 << 14
SEGMENT_BYTES = 1 << 23
#: Alternatives that the literals of a pattern may have before it counts as one that needs none.
ALTERNATIVES = 32
#: Up to so many candidates their ids are given to the scan of the texts as ranges.
LISTED_CANDIDATES = 1_000
IDS = -1

PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 _<>=\"'/,;:!@#%&~`-")
ESCAPED = set(".\\+*?[]^$(){}|/-<>=\"'#&~@! ")


# Literals of a pattern


def literals(pattern: str) -> list[list[str]] | None:
    """Alternatives, each a list of literals that a match of it holds, or None if the pattern says too little.

    What isn't understood is skipped over, which only asks for less.
    """
    branches = _branches(pattern)
    if branches is None:
        return None
    found = []
    for branch in branches:
        runs = _runs(branch)
        if runs is None:
            return None
        found += runs
    return found if len(found) <= ALTERNATIVES else None


def _skip_class(pattern: str, at: int) -> int | None:
    """The place behind a bracket expression."""
    depth = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 1
        elif pattern[at] == "[":
            depth += 1
            if pattern[at + 1 : at + 2] == "^":
                at += 1
            if pattern[at + 1 : at + 2] == "]":
                at += 1
        elif pattern[at] == "]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def _group_end(pattern: str, at: int) -> int | None:
    """The place of the parenthesis that closes the one at a place."""
    depth = 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 1
        elif pattern[at] == "[":
            behind = _skip_class(pattern, at)
            if behind is None:
                return None
            at = behind - 1
        elif pattern[at] == "(":
            depth += 1
        elif pattern[at] == ")":
            depth -= 1
            if not depth:
                return at
        at += 1
    return None


def _branches(pattern: str) -> list[str] | None:
    """The alternatives of a pattern outside of groups."""
    if "\\Q" in pattern or "(?" in pattern.replace("(?:", ""):
        return None
    out, begin, at = [], 0, 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 1
        elif pattern[at] == "[":
            behind = _skip_class(pattern, at)
            if behind is None:
                return None
            at = behind - 1
        elif pattern[at] == "(":
            end = _group_end(pattern, at)
            if end is None:
                return None
            at = end
        elif pattern[at] == "|":
            out.append(pattern[begin:at])
            begin = at + 1
        at += 1
    return [*out, pattern[begin:]]


def _runs(branch: str) -> list[list[str]] | None:
    """For each choice among plain groups, the literals in a branch."""
    choices: list[list[str]] = [[""]]  # the last literal of each is still growing
    at = 0

    def grow(parts: list[str]) -> None:
        nonlocal choices
        choices = [[*done, last + part] for *done, last in choices for part in parts]

    def cut() -> None:
        for choice in choices:
            if choice[-1]:
                choice.append("")

    while at < len(branch):
        c = branch[at]
        atom: list[str] | None = None
        if c in PLAIN:
            atom, at = [c], at + 1
        elif c == "\\":
            if branch[at + 1 : at + 2] in ESCAPED:
                atom = [branch[at + 1]]
            at += 2
        elif c == "[":
            at = _skip_class(branch, at) or len(branch)
        elif c == "(":
            end = _group_end(branch, at)
            inner = branch[at + 1 : end].removeprefix("?:")
            parts = inner.split("|")
            if all(set(part) <= PLAIN for part in parts):
                atom = parts
            at = (end or len(branch)) + 1
        else:
            at += 1
        repeated = branch[at : at + 1]
        if repeated and repeated in "?*+{":
            if atom is not None and repeated == "+":
                grow(atom)
            while at < len(branch) and branch[at] in "?*+":
                at += 1
            if branch[at : at + 1] == "{":
                at = branch.find("}", at) + 1 or len(branch)
                while at < len(branch) and branch[at] in "?+":
                    at += 1
            cut()
        elif atom is None:
            cut()
        else:
            grow(atom)
        if len(choices) > ALTERNATIVES:
            return None
    return [[run for run in choice if run] for choice in choices]


def trigrams(text: str) -> set[int]:
    raw = text.lower().encode("ascii", "replace")
    return {raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)}


def needed(pattern: str) -> list[list[int]] | None:
    """For each alternative of a pattern the trigrams that a match holds; None if one of them has none."""
    found = literals(pattern)
    if found is None:
        return None
    sets = [sorted(set().union(*[trigrams(run) for run in runs])) for runs in found]
    return sets if all(sets) else None


# Building


def segment_rows(build: str, rows_each: int, bytes_each: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(segment, trigram, places, ids) of (id, text): one row per segment and trigram, and one with the ids."""
    marker = IDS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = str.maketrans("İıſK", "iisk")
        number, part = 0, TaskContext.get().partitionId()
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = to = 0
            while to < whole.num_rows:
                at, full = to, (ends[to - 1] if to else 0) + bytes_each
                to = min(at + rows_each, max(at + 1, int(np.searchsorted(ends, full, side="right"))))
                batch = whole.slice(at, to - at)
                held = [np.empty(0, np.int64)]  # trigram and place in one number
                for place, text in enumerate(batch.column(1)):
                    raw = (text.as_py() or "").translate(same).lower().encode("utf-8", "replace")
                    raw = np.frombuffer(raw, dtype=np.uint8)
                    if len(raw) < 3:
                        continue
                    plain = (raw >= 32) & (raw < 127)
                    codes = raw.astype(np.int32)
                    codes = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:])[plain[:-2] & plain[1:-1] & plain[2:]]
                    held.append(np.unique(codes).astype(np.int64) << 16 | place)
                both = np.concatenate(held)
                del held
                both.sort()
                codes, place = (both >> 16).astype(np.int32), (both & 0xFFFF).astype("<u2")
                del both
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, int)
                packed = []
                width = (batch.num_rows + 7) // 8
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(codes)]):
                    if 2 * (b - a) <= width:
                        packed.append(b"p" + place[a:b].tobytes())
                    else:
                        bits = np.zeros(batch.num_rows, dtype=np.uint8)
                        bits[place[a:b]] = 1
                        packed.append(b"b" + np.packbits(bits).tobytes())
                n = len(packed)
                ids = pa.ListArray.from_arrays(
                    pa.array([0] * (n + 1) + [batch.num_rows], pa.int32()), batch.column(0)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{build}-{part}-{number}"] * (n + 1)),
                        pa.array([*codes[first].tolist(), marker], pa.int32()),
                        pa.array([*packed, b""], pa.binary()),
                        ids,
                    ],
                    names=["segment", "trigram", "places", "ids"],
                )
                number += 1

    return rows


def common_places(alternatives: list[list[int]]) -> Callable:
    """The places of a segment that hold all trigrams of one of the alternatives."""

    def places(held: dict[int, bytes]) -> np.ndarray:
        out = np.empty(0, dtype=np.int64)
        for wanted in alternatives:
            if any(code not in held for code in wanted):
                continue
            common = None
            for code in sorted(wanted, key=lambda c: len(held[c])):
                packed = held[code]
                if packed[:1] == b"p":
                    own = np.frombuffer(packed[1:], dtype="<u2").astype(np.int64)
                else:
                    own = np.flatnonzero(np.unpackbits(np.frombuffer(packed[1:], dtype=np.uint8)))
                common = own if common is None else np.intersect1d(common, own, assume_unique=True)
            out = np.union1d(out, common)
        return out.astype(np.int32)

    return places


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    id_col: str

    @property
    def postings(self) -> DataFrame:
        """(segment, trigram, places) in the order of trigrams."""
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def segments(self) -> DataFrame:
        """(segment, ids): the rows of each segment."""
        return self.spark.read.parquet(f"{self.path}/segments")

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids of the rows that can match a pattern; None if it needs no literals."""
        alternatives = needed(pattern)
        if alternatives is None:
            return None
        codes = sorted({code for wanted in alternatives for code in wanted})
        wanted = self.postings.where(in_ranges("trigram", codes)).where(F.col("trigram").isin(codes))
        held = wanted.groupBy("segment").agg(F.collect_list(F.struct("trigram", "places")).alias("held"))
        places = common_places(alternatives)  # per segment as many entries as the pattern has trigrams

        @F.arrow_udf("array<int>")
        def matching(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = [places({e["trigram"]: e["places"] for e in row}) for row in batch.to_pylist()]
                yield pa.array([f.tolist() for f in found], pa.list_(pa.int32()))

        found = held.select("segment", matching("held").alias("at")).where(F.size("at") > 0)
        rows = found.join(self.segments, "segment").select("ids", F.explode("at").alias("at"))
        return rows.select(F.get("ids", F.col("at")).alias(self.id_col))

    def search(self, df: DataFrame, pattern: str, matches: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Rows of a table that `matches` leaves, looked for among the candidates."""
        found = self.candidates(pattern)
        if found is None:
            return matches(df)
        listed = found.limit(LISTED_CANDIDATES + 1).collect()
        if len(listed) <= LISTED_CANDIDATES:
            ids = sorted({row[0] for row in listed if row[0] is not None})
            df = df.where(in_ranges(self.id_col, ids))
            found = found.sparkSession.createDataFrame(listed, found.schema)
        return matches(df.join(found.distinct(), self.id_col, "left_semi"))


def build_search_index(
    corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> SearchIndex:
    """Index the texts of a table under a path, by default a new one in the shared folder."""
    spark = corpus.sparkSession
    path = path or new_path(spark, "search-index")
    rows = corpus.select(id_col, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"segment string, trigram int, places binary, ids array<{kind}>"
    made = rows.mapInArrow(segment_rows(uuid4().hex[:12], SEGMENT_ROWS, SEGMENT_BYTES), schema)
    made.write.parquet(f"{path}/parts")
    parts = spark.read.parquet(f"{path}/parts")
    postings = parts.where(F.col("trigram") != IDS).select("segment", "trigram", "places")
    ordered = postings.repartitionByRange("trigram", "segment").sortWithinPartitions("trigram", "segment")
    ordered.write.parquet(f"{path}/postings")
    parts.where(F.col("trigram") == IDS).select("segment", "ids").write.parquet(f"{path}/segments")
    return SearchIndex(spark, path, id_col)


def corpus_search_index(
    spark: SparkSession, corpus_path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> SearchIndex:
    """The search index of a stored Parquet table, kept in the shared folder while its files stay the same."""
    key = files_digest([*files_of(spark, corpus_path), (id_col, 0, text_col)])
    place = f"{folder or shared_folder(spark)}/search-index-{key[:24]}"

    def make() -> str:
        path = f"{place}/{uuid4().hex}"
        return json.dumps(build_search_index(spark.read.parquet(corpus_path), id_col, text_col, path).path)

    return SearchIndex(spark, json.loads(remembered(spark, place, make)), id_col)
