import pytest

from tests.session import local_session

YARD = [
    "The ferry leaves at dawn; bring a lantern and a coat.",
    "Rain all week.",
    "Who moved the lantern, and who moved the ladder?",
    "Our ladder is too short for that window.",
    "Tick, tick, tick: it's the clock again. Tick!",
    "She doesn't answer letters in winter.",
    "A kettle, a pan, two kettles and it's still cold in here.",
    "it's LATE. IT'S VERY LATE.",
    "Plum jam or quince jam?",
    "QUINCE JAM.",
    "Have you seen my notebook near the clock?",
    "My notebook was under the ladder.",
    "Éclairs après midi, naturally.",
]


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture(scope="session")
def yard(spark):
    """Thirteen short texts."""
    rows = list(enumerate(YARD))
    return spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)


@pytest.fixture(scope="session")
def gapped(yard):
    """The same without the first three, ids kept."""
    return yard.where("doc_id >= 3")


def values(df, column, key="doc_id"):
    """One column as a list in key order."""
    return [row[column] for row in df.select(key, column).orderBy(key).collect()]


def occurrences(*keywords, texts=YARD):
    """How often the keywords occur in each text, case aside."""
    return [sum(text.lower().count(k.lower()) for k in keywords) for text in texts]
