import hashlib
import random

from pyspark.sql import functions as F

from siftwork.llm import syncmers
from siftwork.llm.catalog import QUERIES


def with_anchors(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return rows.select("i", syncmers.anchors(syncmers.word_list(F.col("text"))).alias("a"))


def test_anchors_depend_on_their_words_only(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    other = [f"v{rng.randrange(500)}" for _ in range(57)]
    texts = [" ".join(words), " ".join(other + words[100:300] + other)]
    a, b = [[(x["at"], x["hash"]) for x in r.a] for r in with_anchors(spark, texts).orderBy("i").collect()]
    inside = [(at - 100 + 57, h) for at, h in a if 100 <= at <= 295]
    assert inside == [(at, h) for at, h in b if 57 <= at <= 252]
    assert len(a) > 100 and max(y - x for (x, _), (y, _) in zip(a, a[1:])) <= 4 + 4


def test_edges_are_minimal(spark):
    words = [f"w{i * 7919 % 101}" for i in range(60)]
    row = with_anchors(spark, [" ".join(words)]).collect()[0]
    hashes = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    h = [r.h for r in hashes.orderBy("i").select(F.xxhash64("w").alias("h")).collect()]
    pairs = spark.createDataFrame(list(zip(range(59), h, h[1:])), "i int, a bigint, b bigint").orderBy("i")
    s = [r.s for r in pairs.select(F.xxhash64("a", "b").alias("s")).collect()]
    assert [x["at"] for x in row.a] == [i for i in range(56) if min(s[i], s[i + 3]) < min(s[i + 1], s[i + 2])]


def test_short_texts_have_one_anchor(spark):
    rows = with_anchors(spark, [None, "", " \n", "a", "a b", "a b c d", " a  b\tc d"]).orderBy("i").collect()
    found = [[(x["at"], x["hash"]) for x in r.a] for r in rows]
    assert all(len(f) == 1 for f in found)
    assert found[0] == found[1] == found[2] and found[5] == found[6] and found[3] != found[4]


def test_likeness_is_exact_below_the_sketch_size(spark):
    row = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5])], "a array<int>, b array<int>")
    assert row.select(syncmers.likeness("a", "b").alias("x")).collect()[0].x == 2 / 5


def test_likeness_estimates_the_share_of_common_anchors(spark):
    rng = random.Random(4)
    for share in (0.2, 0.5, 0.8):
        both = [rng.getrandbits(31) for _ in range(int(2000 * share))]
        rest = [[rng.getrandbits(31) for _ in range((2000 - len(both)) // 2)] for _ in "ab"]
        rows = spark.createDataFrame([(sorted(both + rest[0])[:64], sorted(both + rest[1])[:64])], "a array<int>, b array<int>")
        assert abs(rows.select(syncmers.likeness("a", "b").alias("x")).collect()[0].x - share) < 0.2


def test_shifts(spark):
    texts = ["p q r s t u v w x y z a b c d e f g", "n m p q r s t u v w x y z a b c d e f g"]
    rows = {r.i: r.a for r in with_anchors(spark, texts).collect()}
    frame = spark.createDataFrame([(rows[0], rows[1])], "a array<struct<at:int,hash:int>>, b array<struct<at:int,hash:int>>")
    found = frame.select(syncmers.shifts("a", "b").alias("s")).collect()[0].s
    assert found and {x["shift"] for x in found} == {2}


def test_edited_texts_by_hand(odd, odd_rows, tmp_path, spark):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op10_syncmers"](spark, str(tmp_path)).collect()}
    texts = [(r[0], r[1] or "") for r in odd_rows]
    assert set(rows) == {d for d, _ in texts}
    for i, (doc_id, text) in enumerate(texts):
        after_id, after = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = rows[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if edited == text:
            assert row.near_edited == 1 and row.fingerprint == row.edited_fingerprint
        if after == text:
            assert row.near_next == 1 and row.fingerprint == rows[after_id].fingerprint
    assert rows[24].fingerprint == rows[21].fingerprint


def test_one_row_empty_table_and_equal_ids(spark, empty):
    one = spark.createDataFrame([(7, "only one text " * 9)], "doc_id bigint, text string")
    assert [(r.key, r.next) for r in syncmers.edited_pairs(one).collect()] == [(7, 7)]
    assert syncmers.edited_pairs(empty).count() == 0
    same = one.union(one).union(spark.createDataFrame([(None, "x")], "doc_id bigint, text string"))
    assert syncmers.edited_pairs(same).count() == 2


def test_sketches_are_the_smallest_hashes_of_the_anchors(spark, odd_rows):
    texts = [r[1] for r in odd_rows] + ["a b c d e", "a a a a a a a a", "a b c d"]
    want = {r.i: sorted({x["hash"] for x in r.a})[:64] for r in with_anchors(spark, texts).collect()}
    frame = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "i int, text string, `b` string")
    rows = syncmers.with_sketches(frame, {"text": "s", "b": "z"})
    assert {r.i: list(r.s) for r in rows.collect()} == want == {r.i: list(r.z) for r in rows.collect()}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") >= 4  # the steps stay apart; as one expression they are lists of objects at once
