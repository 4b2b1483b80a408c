import zlib

import numpy as np
import pytest

from siftwork.llm import pack
from siftwork.llm.catalog import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("length", [16, 4096])
def test_pieces_hold_every_id_once(odd, odd_rows, tokenizer, length):
    rows = pack.pack(odd, tokenizer_path(), length).collect()
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in odd_rows}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
    assert set(by_doc) == set(ids)
    for doc_id, found in by_doc.items():
        found.sort(key=lambda r: r.start)
        assert [r.start for r in found] == [sum(x.length for x in found[:i]) for i in range(len(found))]
        assert sum(r.length for r in found) == len(ids[doc_id])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, found in by_sequence.items():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == [sum(x.length for x in found[:i]) for i in range(len(found))]
        total = sum(r.length for r in found)
        assert total == length if number < max(by_sequence) else total <= length


def test_padding_spares_powers_of_two(spark):
    cut = spark.createDataFrame([(0, 4096), (1, 512), (1, 512), (2, 100)], "sequence_id bigint, length bigint")
    assert {r.sequence_id: r.padded for r in pack.padded(cut).collect()} == {0: 4096, 1: 1024, 2: 4096}


def test_empty_table_and_repeated_rows(odd, empty, odd_rows):
    assert pack.pack(empty, tokenizer_path()).count() == 0
    twice = pack.pack(odd.union(odd), tokenizer_path(), 64)
    total = sum(r.length for r in twice.collect())
    assert total == 2 * sum(r.length for r in pack.pack(odd, tokenizer_path(), 64).collect())


def test_cached_words_equal_the_tokenizer(tokenizer):
    import pyarrow as pa

    texts = ["The the. THE, the.. a. é. É, ñ. ×. 1. 's it's. x́. ÷, c\xb7. Straße. —."] * 2
    ids, counts = pack.Encoder(tokenizer_path()).texts(pa.array(texts))
    want = tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and counts.tolist() == [len(want)] * 2


def test_other_tokenizers_get_whole_texts(odd_rows):
    tokenizers = pytest.importorskip("tokenizers")
    import pyarrow as pa

    other = tokenizer_path().replace("word_bpe_49k", "byte_bpe_50k")
    encode = tokenizers.Tokenizer.from_file(other).encode
    texts = [t for _, t, *_ in odd_rows]
    ids, counts = pack.Encoder(other).texts(pa.array(texts))
    want = [encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert pack.word_by_word(tokenizer_path()) and not pack.word_by_word(other)


@pytest.mark.parametrize("most", [0, 100_000])
def test_order_over_splits_of_a_file_that_do_not_touch(spark, monkeypatch, most):
    """One task holds the first and the third split of a file, another the second; rows keep the file's order."""
    monkeypatch.setattr(pack, "STRETCHES", most)
    rows = [(i, f"word {i}", f, s, r) for i, (f, s, r) in enumerate((f, s, 3 * s + k) for f in "ab" for s in range(3) for k in range(3))]
    one = [r for r in rows if (r[2], r[3]) != ("a", 1)]
    schema = "doc_id bigint, text string, file string, split bigint, row bigint"
    docs = spark.createDataFrame(one, schema).coalesce(1).union(spark.createDataFrame(rows[3:6], schema).coalesce(1))
    found = pack.pack(docs, tokenizer_path(), 16, order=("file", "split", "row")).collect()
    found.sort(key=lambda r: (r.sequence_id, r.offset))
    assert list(dict.fromkeys(r.doc_id for r in found)) == list(range(18))


def test_a_text_over_four_megabytes(spark, tokenizer):
    text = "tide lamp quay " * 300_000
    docs = spark.createDataFrame([(1, text), (2, "end")], "doc_id bigint, text string")
    found = sorted(pack.pack(docs, tokenizer_path()).collect(), key=lambda r: (r.doc_id, r.start))
    want = tokenizer.encode("tide lamp quay", add_special_tokens=False).ids * 300_000 + [2]
    assert len(want) == found[0].doc_tokens and sum(r.length for r in found if r.doc_id == 1) == len(want)
    for r in found:
        if r.doc_id == 1:
            assert r.ids_crc32 == crc(want[r.start : r.start + r.length])
