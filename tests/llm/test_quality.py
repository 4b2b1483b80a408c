import re
from collections import Counter

from siftwork.llm import quality


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if grams[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "alpha_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7F]", w)) for w in words),
    }


def test_measures_by_hand(odd, odd_rows):
    got = {r.doc_id: r.asDict() for r in quality.ledger(odd).collect()}
    assert len(got) == len(odd_rows)
    for doc_id, text, *_ in odd_rows:
        want = by_hand(text)
        assert {k: got[doc_id][k] for k in want} == want, text


def test_bits_follow_the_rules(odd):
    for row in quality.ledger(odd).collect():
        assert bool(row.failures & 1) == (row.n_words < 50)
        assert bool(row.failures & 2) == (100 * row.n_repeat_words > 50 * row.n_words)


def test_policies_and_ablations(odd):
    rows = quality.ledger(odd)
    bits = [r.failures for r in rows.collect()]
    assert rows.where(quality.passes(1)).count() == sum(b & 3 == 0 for b in bits)
    for row in quality.ablations(rows).collect():
        bit = quality.mask((row.rule,))
        assert row.rejects == sum(bool(b & bit) for b in bits)
        assert row.rejects_alone == sum(b == bit for b in bits)
        assert row.kept_without == sum(b & ~bit == 0 for b in bits)


def test_filter_keeps_rows_whole(odd, empty):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns
    good = {r.doc_id for r in quality.ledger(odd).where(quality.passes()).collect()}
    assert {r.doc_id for r in kept.collect()} == good and good
    assert quality.filter_documents(empty).count() == 0
    assert quality.ledger(empty).count() == 0
    twice = odd.union(odd)
    assert quality.filter_documents(twice).count() == 2 * len(good)


def test_only_rule_and_report_from_the_stored_ledger(odd, empty):
    rows = quality.stored_ledger(odd)
    names = {quality.mask((r.name,)): r.name for r in quality.RULES}
    got = rows.select("failures", quality.only_rule().alias("only")).collect()
    assert all(r.only == names.get(r.failures) for r in got) and any(r.only for r in got)
    lines = []
    for bit, name in names.items():
        bits = [r.failures for r in got]
        counts = sum(bool(b & bit) for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits)
        lines.append(":".join(map(str, (name, *counts))))
    assert quality.ablation_report(rows).first().ablation == ",".join(sorted(lines))
    nothing = quality.stored_ledger(empty)
    assert nothing.count() == 0 and quality.ablation_report(nothing).first().ablation == ""


def test_length_needs_no_python(odd, odd_rows, empty):
    kept = quality.filter_by_length(odd.union(odd))
    assert kept.columns == odd.columns and "Python" not in kept._jdf.queryExecution().toString()
    long = sorted(2 * [r[0] for r in odd_rows if by_hand(r[1])["n_words"] >= 50])
    assert sorted(r.doc_id for r in kept.collect()) == long and long
    assert quality.filter_by_length(empty).count() == 0
    for row in odd.select("text", quality.word_count("text").alias("n")).collect():
        assert row.n == by_hand(row.text)["n_words"]
