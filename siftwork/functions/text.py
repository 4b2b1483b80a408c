"""Text functions: keyword counts, tokens, highlighting and row decoration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.stopwords import ENGLISH

ColumnLike = Column | str

# Fixed values.
KEYWORD_COLOR = "yellow"
SEARCH_COLOR = "white"
ESCAPED_SYMBOLS = "*()|[]-+"
SHORT_LENGTH = 25
POSITIVE_CLASS = "orange"
NEGATIVE_CLASS = "blue"

# Two or more letters, digits or underscores of any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
BETWEEN_TOKENS = r"[^\p{L}\p{N}_]+"


def _col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def keyword_count(text: ColumnLike, keywords: Iterable[str], weight: float = 1.0) -> Column:
    """Occurrences of the keywords in the text, ignoring case, times the weight.

    A keyword counts as a literal substring and its matches do not overlap. Blank keywords are
    skipped and a keyword given twice counts twice. A null text counts as 0. Byte lengths are read
    from the string header, so each keyword costs one pass over the text.
    """
    lowered = F.lower(_col(text))
    total = F.lit(0.0)
    for keyword in keywords:
        if not keyword.strip():
            continue
        needle = keyword.lower()
        left = F.replace(lowered, F.lit(needle), F.lit(""))
        removed = F.octet_length(lowered) - F.octet_length(left)
        total = total + removed / F.lit(len(needle.encode("utf-8")))
    return F.coalesce(total * F.lit(float(weight)), F.lit(0.0))


def keyword_counts(text: ColumnLike, keyword_sets: Sequence[Sequence[str]]) -> Column:
    """Occurrences of each set's keywords, as an array of one number per set, in one pass over the text.

    The same counts as ``keyword_count``: literal, ignoring case, matches of one keyword don't overlap, blank
    keywords are skipped, repeated ones count again, a null text counts 0. All keywords of all sets make one
    automaton, so the time hardly depends on how many there are.
    """
    shares: dict[str, dict[int, int]] = {}  # how often each set lists a keyword
    for number, keywords in enumerate(keyword_sets):
        for keyword in keywords:
            if keyword.strip():
                own = shares.setdefault(keyword.lower(), {})
                own[number] = own.get(number, 0) + 1
    entries = [(keyword, tuple(own.items())) for keyword, own in sorted(shares.items())]
    size = len(keyword_sets)

    @F.arrow_udf("array<double>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for at, (keyword, _) in enumerate(entries):
            automaton.add_word(keyword, (at, len(keyword)))
        automaton.make_automaton()
        for batch in batches:
            values = []
            for text in batch.to_pylist():
                totals = [0.0] * size
                free: dict[int, int] = {}  # where the next match of a keyword may begin
                for end, (at, length) in automaton.iter(text) if text and entries else ():
                    if end - length + 1 >= free.get(at, 0):
                        free[at] = end + 1
                        for number, times in entries[at][1]:
                            totals[number] += times
                values += totals
            bounds = pa.array(range(0, size * len(batch) + 1, size), pa.int32())
            yield pa.ListArray.from_arrays(bounds, pa.array(values, pa.float64()))

    return count(F.lower(_col(text)))


def words(text: ColumnLike) -> Column:
    """All lower-case words of at least two word characters, in text order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def spaced_words(text: ColumnLike) -> Column:
    """The lower-case text with one space for all that is no word character; words of one character stay."""
    return F.regexp_replace(F.lower(_col(text)), F.lit(BETWEEN_TOKENS), F.lit(" "))


def tokenize(text: ColumnLike, stop_words: Sequence[str] = ENGLISH) -> Column:
    """The words of the text without stop words, in text order."""
    found = words(text)
    if not stop_words:
        return found
    return F.filter(found, lambda word: ~word.isin(list(stop_words)))


def short_text(text: ColumnLike) -> Column:
    """The first characters of a text, used as its display name."""
    return F.substring(_col(text), 1, SHORT_LENGTH)


def keyword_regex(keywords: Iterable[str]) -> str:
    """Alternation of the keywords; only the listed symbols are escaped, empty keywords dropped."""
    escapes = {ord(symbol): "\\" + symbol for symbol in ESCAPED_SYMBOLS}
    return "|".join(keyword.translate(escapes) for keyword in keywords if keyword)


def combined_regex(keyword_sets: Iterable[Iterable[str]]) -> str:
    """One group over the regexes of all keyword features, or "" when there is none."""
    parts = [part for part in map(keyword_regex, keyword_sets) if part]
    return f"({'|'.join(parts)})" if parts else ""


def ignore_case(pattern: str) -> str:
    """Pattern with case folding and character classes that cover all of Unicode."""
    return f"(?iU){pattern}"


def highlight(text: ColumnLike, regex: str, color: str = KEYWORD_COLOR) -> Column:
    """Wrap what the first group of each match holds in a coloured span."""
    if regex in ("", "()"):
        return _col(text)
    span = f"<span style='background-color: {color}; color: black;'>$1</span>"
    return F.regexp_replace(_col(text), ignore_case(regex), span)


def highlight_keywords_and_search(text: ColumnLike, keyword_regex: str, search: str) -> Column:
    """Mark keywords, then mark the search text over the marked-up result.

    The second pass sees the markup of the first one, so a search for "span" also hits the tags.
    """
    return highlight(highlight(text, keyword_regex), f"({search})", SEARCH_COLOR)


def prediction_span(text: ColumnLike, prediction: Column | None) -> Column:
    """Text in a span coloured by its predicted class, or a plain span when unscored."""
    if prediction is None:
        return F.concat(F.lit("<span>"), _col(text), F.lit("</span>"))
    name = F.when(prediction > 0.5, POSITIVE_CLASS).otherwise(NEGATIVE_CLASS)
    return F.concat(
        F.lit("<span class='"), name, F.lit("--text darken-1'>"), _col(text), F.lit("</span>")
    )


def label_badge(label: Column) -> Column:
    """Badge markup of a label: empty when unlabelled, else coloured by class."""
    name = F.when(label == 1, POSITIVE_CLASS).otherwise(NEGATIVE_CLASS)
    badge = F.concat(F.lit("<span class='"), name, F.lit("--text darken-1'>Labeled</span>"))
    return F.when(label == -1, F.lit("")).otherwise(badge)
