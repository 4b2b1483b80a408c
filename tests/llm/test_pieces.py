import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from siftwork.llm import pieces
from siftwork.llm.catalog import PIECES, op11_pieces, tokenizer_path


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(tokenizer_path(PIECES))


def hostile():
    rng = random.Random(3)
    out = ["", None, " ", "  ", "▁", " " * 100 + "the" + " " * 33 + "a", "the" * 500, "ab" * 800, "a" * 3000, "\x00\n\t"]
    alphabets = ["ab", "the ", "aA1 ▁", "etaoinshrdlu ", "é ñü中文字 \n", "<s>/[]{}()  ;=", "0123456789abcdef", "\U0001f600́ß "]
    for _ in range(800):
        alphabet = rng.choice(alphabets)
        out.append("".join(rng.choice(alphabet) for _ in range(rng.choice([3, 10, 40, 200, 900]))))
    return out


def split(ids, sizes):
    at = np.append(0, np.cumsum(sizes)).tolist()
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("span", [1 << 21, 61])
def test_ids_equal_the_library(codec, library, monkeypatch, span):
    monkeypatch.setattr(pieces, "SPAN_CHARS", span)
    texts = hostile()
    got = split(*codec.texts(pa.array(texts, pa.string())))
    assert got == library.encode([t or "" for t in texts])


def test_words_of_one_hash_are_told_apart(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "span_hashes", lambda data, start, end: np.zeros(len(start), dtype=np.uint64))
    texts = ["the tide the lamp", "quay"]
    assert split(*codec.texts(pa.array(texts))) == library.encode(texts)


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(5)
    lists = [[rng.randrange(32000) for _ in range(rng.randrange(12))] for _ in range(500)]
    lists += [[rng.randrange(300) for _ in range(rng.randrange(12))] for _ in range(500)]  # mostly bytes
    flat, sizes = np.array([i for x in lists for i in x], dtype=np.int32), np.array([len(x) for x in lists])
    assert codec.decode(flat, sizes) == [library.decode(x) for x in lists]


def test_query_on_odd_rows(spark, odd, odd_rows, empty, library, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_pieces(spark, str(tmp_path)).collect()}
    assert len(got) == len(odd_rows)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for doc_id, text, *_ in odd_rows:
        ids = library.encode(text or "", add_eos=True)
        r = got[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(" ".join(map(str, ids)))
        assert r.decoded_sha256 == digest(library.decode(ids))
    assert pieces.encode(empty, tokenizer_path(PIECES), decoded=True).count() == 0
    assert pieces.encode(odd.union(odd), tokenizer_path(PIECES)).count() == 2 * len(odd_rows)


def test_ids_column_back_to_text_and_very_long_texts(spark, library):
    long = "lamp Überfahrt 7 tide " * 200_000  # over 4 MB
    rows = spark.createDataFrame([(1, long), (2, "a  b"), (None, "x")], "doc_id int, text string")
    ids = pieces.encode(rows, tokenizer_path(PIECES))
    found = {r.key: r for r in ids.select("key", "ids", pieces.decode("ids", tokenizer_path(PIECES)).alias("t")).collect()}
    assert found[1].t == long and found[2].t == "a  b" and found[None].t == "x"
    assert found[1].ids == library.encode(long, add_eos=True)
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert nothing.select(pieces.decode("ids", tokenizer_path(PIECES)).alias("t")).collect()[0].t is None
