import random
import re

from siftwork.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def change(rng, line, alphabet):
    out = bytearray(line)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice(alphabet))
        elif i < len(out):
            out[i : i + 1] = b"" if kind == 1 else bytes([rng.choice(alphabet)])
    return bytes(out)


def by_hand(docs):
    """doc_id to (n_lines, n_exact, n_near, n_links, removed) by comparing all lines with all."""
    places = {}
    rows = []
    for doc_id, text in docs:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            if re.search(lines.WORD, line):
                raw = line.encode()
                rows.append((doc_id, at, raw))
                places[raw] = min(places.get(raw, (doc_id, at)), (doc_id, at))
    linked = {a: [] for a in places}
    for a in places:
        for b in places:
            limit = min(2, min(len(a), len(b)) // 20)
            if a < b and abs(len(a) - len(b)) <= limit and edits(a, b) <= limit:
                linked[a].append(b)
                linked[b].append(a)
    out = {}
    for doc_id, at, raw in rows:
        n = out.setdefault(doc_id, [0, 0, 0, 0, []])
        exact = places[raw] != (doc_id, at)
        near = not exact and any(places[o] < places[raw] for o in linked[raw])
        n[0] += 1
        n[1] += exact
        n[2] += near
        n[3] += len(linked[raw])
        if exact or near:
            n[4].append(at)
    return out


def test_banded_distance(spark):
    rng = random.Random(2)
    pairs = []
    while len(pairs) < 1500:
        a = bytes(rng.choice(b"ab=") for _ in range(rng.randrange(12)))
        b = change(rng, a, b"abx")
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, b))
    for r in lines.with_distance(spark.createDataFrame(pairs, "x binary, y binary")).collect():
        assert min(edits(r.x, r.y), 3) == min(r.distance, 3), (r.x, r.y)


def near_docs():
    rng = random.Random(5)
    base = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (19, 20, 21, 38, 39, 40, 41, 42, 80, 200)]
    made = [b"x" + line[1:] for line in base]
    for line in list(made):
        made += [change(rng, line, b"abcde") for _ in range(6)]
    rng.shuffle(made)
    texts = ["\n".join(m.decode() for m in made[i : i + 4]) for i in range(0, len(made), 4)]
    return list(enumerate(texts + texts[:3] + [None, "", "\n \n", "éclair " * 8 + "\neclair " * 8]))


def test_decisions_by_hand(spark):
    docs = near_docs()
    got = lines.decisions(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    rows = {r.key: [r.n_lines, r.n_exact, r.n_near, r.n_links, r.removed] for r in got}
    want = by_hand(docs)
    assert rows == want
    assert sum(v[1] for v in want.values()) and sum(v[2] for v in want.values())


def test_hostile_rows(odd, odd_rows, empty):
    want = by_hand([(r[0], r[1]) for r in odd_rows])
    rows = lines.decisions(odd).collect()
    assert {r.key: [r.n_lines, r.n_exact, r.n_near, r.n_links, r.removed] for r in rows} == want
    assert lines.decisions(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0


def test_texts_lose_their_removed_lines(spark):
    docs = near_docs()
    frame = spark.createDataFrame([(d, t, len(t or ""), 1) for d, t in docs], "doc_id bigint, text string, n_chars int, own int")
    out = lines.dedup_lines(frame)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    gone = {d: v[4] for d, v in by_hand(docs).items()}
    want = {}
    for d, t in docs:
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, []))
        if not gone.get(d) or re.search(lines.WORD, kept):
            want[d] = (t, len(t or "")) if not gone.get(d) else (kept, len(kept))
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == want


def test_null_and_repeated_ids(spark):
    line = "a line of more than forty bytes that is repeated here"
    docs = spark.createDataFrame([(None, line), (3, line), (3, line), (4, line + "!")], "doc_id bigint, text string")
    got = {r.key: (r.n_lines, r.n_exact, r.n_near) for r in lines.decisions(docs).collect()}
    assert got == {None: (1, 0, 0), 3: (2, 2, 0), 4: (1, 0, 1)}
    assert [r.doc_id for r in lines.dedup_lines(docs).collect()] == [None]
