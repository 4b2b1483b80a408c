import random

import pytest

from siftwork.llm import automata


def by_hand(rows):
    """(doc_id, text) to (n_words, n_removed, kept words); of equal windows the first place stays."""
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    place = lambda d: (d is not None, d or 0)
    for d, w in texts:
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (place(d), i)), (place(d), i))
    out = []
    for d, w in texts:
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (place(d), i):
                keep[i : i + 20] = [False] * 20
        left = [x for x, k in zip(w, keep) if k]
        out.append((d, len(w), len(w) - len(left), b" ".join(left).decode()))
    return sorted(out, key=str)


def passages():
    """Texts that share passages of 19 to 120 words at any place, copies, loops and periodic texts."""
    rng = random.Random(11)
    word = lambda: rng.choice("tide lamp quay oak été b x1 the of".split()) + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 60, 120)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[a:] if rng.random() < 0.5 else p
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " more"), (102, "a " * 90), (103, "a b c " * 30), (104, None)]
    return rows + [(105, ""), (106, " ".join(shared[4])), (107, " ".join(shared[4][:50] + ["gap"] + shared[4][50:]))]


def result(frame):
    rows = automata.remove_repeats(frame).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


@pytest.mark.parametrize(("hot", "shard"), [(10_000, 100_000), (3, 500)])
def test_passages_by_hand(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(automata, "HOT", hot)
    monkeypatch.setattr(automata, "SHARD_WORDS", shard)
    rows = passages()
    got = result(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert got == by_hand(rows)
    assert sum(r[2] for r in got) > 500


def test_hostile_rows(odd, odd_rows, empty):
    assert result(odd) == by_hand([(r[0], r[1]) for r in odd_rows])
    assert automata.remove_repeats(empty).count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (5, text), (6, "x " + text), (7, text + " y"), (7, "z " + text)]
    assert result(spark.createDataFrame(rows, "doc_id bigint, text string")) == by_hand(rows)
    same = [(1, text), (1, text), (1, "other " * 3)]
    assert [r[2] for r in result(spark.createDataFrame(same, "doc_id bigint, text string"))] == [0, 0, 0]


def test_automata_have_few_first_and_second_letters():
    letters = automata.Letters()
    pairs = [letters[b"w%d" % i] for i in range(automata.SHARD_WORDS)]
    assert len(set(pairs)) == len(pairs) and {len(p) for p in pairs} == {2}
    first, second = ({p[i] for p in pairs} for i in (0, 1))
    assert not first & second and max(len(first), len(second)) < 400
