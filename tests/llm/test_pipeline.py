import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from siftwork.llm import quality
from siftwork.llm.catalog import tokenizer_path
from tests.llm.conftest import SCHEMA, odd_texts
from tests.llm.test_jaccard import likeness, set_of
from tests.llm.test_lines import by_hand as lines_by_hand
from tests.llm.test_mix import by_hand as mixed_by_hand
from tests.llm.test_quality import by_hand as measured


def corpus():
    """Clean texts, junk, copies, near copies and shared lines from three sources and none."""
    rng = random.Random(9)
    word = lambda: rng.choice("tide lamp quay harbour été of the and".split()) + str(rng.randrange(60))
    texts = ["\n".join(" ".join(word() for _ in range(30)) for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    texts += [texts[3], texts[5] + ".", texts[7] + "\n" + texts[8], "# $ % & * " * 30] + odd_texts()[:-1]
    sources = ["s0", "s0", "s0", "s0", "s1", None, "s2"]
    return [
        (i, t, "en", sources[i % 7], None if t is None else len(t)) for i, t in enumerate(texts)
    ]


def kept_by_rules(rows):
    def fine(text):
        m = measured(text)
        return not (
            m["n_words"] < 50 or 2 * m["n_repeat_words"] > m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
            or 2 * m["n_dup_lines"] > m["n_lines"] or not 2 * m["n_words"] <= m["word_chars"] <= 25 * m["n_words"]
            or 100 * m["alpha_words"] < 60 * m["n_words"]
        )

    return [r for r in rows if fine(r[1])]


def without_lines(rows):
    gone = {d: v[4] for d, v in lines_by_hand([r[:2] for r in rows]).items()}
    out = []
    for d, t, lang, source, n in rows:
        if gone.get(d):
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
            n = len(t)
        if re.search(r"[^\x20\x09-\x0D]", t) and measured(t)["n_words"] >= 50:  # the length rule holds for what is left
            out.append((d, t, lang, source, n))
    return out


def first_of_groups(rows, before):
    """Rows that are the first of all groups that they are in, by their texts and those of before."""
    was = {r[0]: r[1] for r in before}
    texts = [(r[0], set_of(t)) for r in rows for t in {r[1], was[r[0]]}]
    group = list(range(len(texts)))
    for i, (_, a) in enumerate(texts):
        for j in range(i):
            if likeness(a, texts[j][1]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min(k for (k, _), h in zip(texts, group) if h == g) for g in set(group)}
    later = {k for (k, _), g in zip(texts, group) if low[g] != k}
    return [r for r in rows if r[0] not in later]


def in_mixed_order(rows):
    """Ids in the order of the mix."""
    return [r[2] for r in mixed_by_hand([(r[0], r[3], r[4]) for r in rows])]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out[name] = docs
    return folder, rows, out


def test_filters_by_hand(stages):
    _, rows, out = stages
    want = kept_by_rules(rows)
    near = lambda found: first_of_groups(found, rows)
    for name, step in (("quality rules", list), ("line dedup", without_lines), ("near dedup", near)):
        want = step(want)
        assert out[name].columns == SCHEMA.replace(",", "").split()[::2]
        assert sorted(tuple(r) for r in out[name].collect()) == sorted(want)
        assert 0 < len(want) < len(rows)


def test_mix_and_packing_by_hand(stages):
    tokenizers = pytest.importorskip("tokenizers")
    encode = tokenizers.Tokenizer.from_file(tokenizer_path()).encode
    _, rows, out = stages
    docs = first_of_groups(without_lines(kept_by_rules(rows)), rows)
    order = in_mixed_order(docs)
    assert Counter(r.doc_id for r in out["mix sources"].collect()) == Counter(order)
    assert set(order) == {r[0] for r in docs}
    size = {r[0]: len(encode(r[1], add_special_tokens=False).ids) + 1 for r in docs}
    want, at = [], 0
    for d in order:
        done = 0
        while done < size[d]:
            n = min(size[d] - done, 4096 - at % 4096)
            want.append((at // 4096, at % 4096, d, done, n, size[d]))
            at, done = at + n, done + n
    got = [(r.sequence_id, r.offset, r.doc_id, r.start, r.length, r.doc_tokens) for r in out["pack"].collect()]
    assert sorted(got) == want


def test_run_applies_the_stages(spark, stages):
    folder, _, out = stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, out["pack"].collect()))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_policy_is_the_current_one():
    assert set(quality.POLICIES[quality.CURRENT]) == {r.name for r in quality.RULES}


def test_line_dedup_runs_no_python(spark, stages):
    folder, _, out = stages
    plan = corpus_pipeline.line_dedup(spark, out["quality rules"], folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
