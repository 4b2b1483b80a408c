import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_texts():
    """Null, empty, blank, accented, symbol-laden, repeated, control-string and long texts."""
    rng = random.Random(7)
    words = ["tide", "lamp", "Überfahrt", "quay", "éclair", "mosaïque", "año", "B", "x1", "of", "the", "and"]
    prose = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 20, 60, 61, 300)]
    return [
        None, "", " \n\t ", "one", "two words", prose[0], prose[1], prose[2], prose[2], prose[3] + ".",
        prose[2] + " tail", "a b c\x0bd\x0ce", "# $ % & | < > *\n# $ % & | < > *\n\n",
        "It's the QUAY, isn't it?.. ÉTÉ. été, naïve—word \U0001f600 ﬁ ß. <|endoftext|> end",
        "same same same " * 30, prose[4] + "\n" + prose[1] + "\n" + prose[1], "́x é Å Σας İ",
        " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(30000)),
    ]


@pytest.fixture(scope="session")
def odd_rows():
    sources = ["s0", "s0", "s0", None, "s1"]
    return [
        (i * 3, text, ["en", None][i % 2], sources[i % 5], None if text is None else len(text))
        for i, text in enumerate(odd_texts())
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """A hostile table with columns that carry the names of results."""
    rows = [row + (1, "x", True) for row in odd_rows]
    return spark.createDataFrame(rows, SCHEMA + ", n_words int, `fp` string, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
