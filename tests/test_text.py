import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.functions.stopwords import ENGLISH
from tests.conftest import occurrences, values

NOTE = "Wash the jars.\nDry the jars, label them;\nstore THE JARS by size (jars!)"


def counted(spark, text, keywords, *weight):
    return spark.range(1).select(T.keyword_count(F.lit(text), keywords, *weight).alias("n")).first().n


def test_keyword_count(spark):
    """Case is ignored, keywords add up, repeated ones count again, blank ones count nothing."""
    assert counted(spark, NOTE, ["jars"]) == 4 == counted(spark, NOTE, ["JaRs"])
    assert counted(spark, NOTE, ["jars", "label"]) == 5
    assert counted(spark, NOTE, ["jars", "jars"]) == 8
    assert counted(spark, NOTE, ["by size ("]) == 1
    for nothing in ([], [""], ["\n", " \t"], ["lids"]):
        assert counted(spark, NOTE, nothing) == 0
    assert counted(spark, NOTE, ["lids", "", "wash"], 3) == 3


def test_keyword_count_per_row(yard):
    for weight in (1, 2):
        rows = yard.withColumn("n", T.keyword_count("text", ["kettle", "it's"], weight))
        assert values(rows, "n") == [weight * n for n in occurrences("kettle", "it's")]


def test_null_text_counts_as_zero(spark):
    one = spark.range(1).select(T.keyword_count(F.lit(None).cast("string"), ["a"]).alias("n"))
    assert one.first().n == 0.0


WORDS = st.text(alphabet="abAB é.*\n", max_size=30)


@settings(max_examples=6, deadline=None)
@given(st.lists(WORDS, min_size=5, max_size=5), st.lists(WORDS, max_size=3))
def test_keyword_count_is_what_python_counts(spark, texts, keywords):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = values(df.withColumn("n", T.keyword_count("text", keywords)), "n")
    want = [
        sum(t.lower().count(k.lower()) for k in keywords if k.strip()) for t in texts
    ]
    assert got == want


# Java and Python know different versions of Unicode; these letters are the same in both.
OLD_SCRIPTS = st.characters(max_codepoint=0x4FF)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(OLD_SCRIPTS, max_size=40), min_size=5, max_size=5))
def test_tokens_are_what_python_finds(spark, texts):
    texts = [t.lower() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = values(df.withColumn("w", T.words("text")), "w")
    lowered = values(df.withColumn("w", F.lower("text")), "w")
    assert got == [re.findall(r"\w\w+", t) for t in lowered]


def test_stop_words_are_the_default_list(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_tokenize_drops_stop_words(spark):
    one = spark.range(1).select(T.tokenize(F.lit("The cat_1 sat ON a mat, été 42!")).alias("t"))
    assert one.first().t == ["cat_1", "sat", "mat", "été", "42"]


def test_combined_regex():
    """Keywords of all sets in one group, escaped; blank ones and empty sets leave nothing behind."""
    assert T.combined_regex([["oak", "elm"], ["ash"]]) == "(oak|elm|ash)"
    assert T.combined_regex([["oak", ""], [], ["", "ash"]]) == "(oak|ash)"
    for empty in ([], [[], []], [["", ""]]):
        assert T.combined_regex(empty) == ""
    wild = "a*b+c|d-[e] (f)"
    assert re.fullmatch(T.combined_regex([[wild, "x"]]), wild)


def shown(spark, column):
    return spark.range(1).select(column.alias("t")).first().t


def test_highlight(spark):
    span = "<span style='background-color: yellow; color: black;'>{}</span>"
    got = shown(spark, T.highlight(F.lit("Elm, then an elm tree"), "(elm|tree)"))
    assert got == span.format("Elm") + ", then an " + span.format("elm") + " " + span.format("tree")
    for blank in ("", "()"):
        assert shown(spark, T.highlight(F.lit("Elm."), blank)) == "Elm."


def test_search_pass_sees_markup(spark):
    got = shown(spark, T.highlight_keywords_and_search(F.lit("elm"), "(elm)", "yellow"))
    assert "background-color: white" in got and got.count("<span") == 2


def test_badges_and_spans(spark):
    rows = spark.createDataFrame([(-1, 0.2), (0, 0.5), (1, 0.7)], "label int, p double")
    shown = rows.select(
        T.label_badge(F.col("label")).alias("badge"),
        T.prediction_span(F.lit("x"), F.col("p")).alias("span"),
        T.prediction_span(F.lit("x"), None).alias("plain"),
    ).collect()
    assert [r.badge for r in shown] == [
        "",
        "<span class='blue--text darken-1'>Labeled</span>",
        "<span class='orange--text darken-1'>Labeled</span>",
    ]
    assert [r.span for r in shown] == [
        "<span class='blue--text darken-1'>x</span>",
        "<span class='blue--text darken-1'>x</span>",
        "<span class='orange--text darken-1'>x</span>",
    ]
    assert shown[0].plain == "<span>x</span>"
