import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm import mix


def weights_by_hand(totals, epochs=mix.EPOCHS, least=mix.LEAST, block=mix.BLOCK):
    """{source_key: (power, entity, phase)}."""
    power = {k: math.floor((float(t) * float(t) ** 0.5) ** 0.5 * 1000) for k, t in totals.items()}
    top_power, top_total = max(power.values()), max(totals.values())
    power = {k: max(1, min(p, totals[k] * epochs * top_power // top_total)) for k, p in power.items()}
    everything = sum(power.values())
    light = {k for k, p in power.items() if p * least < everything}
    if light and sum(power[k] for k in light) * least < everything:
        light.add(min((p, k) for k, p in power.items() if k not in light)[1])
    seeded = {k: int(hashlib.md5((mix.SEED + k).encode()).hexdigest()[:8], 16) for k in light}
    return {
        k: (p, "*" if k in light else k, seeded[k] % min(totals[k], block) if k in light else 0) for k, p in power.items()
    }


def by_hand(rows, block=mix.BLOCK, slots=mix.SLOTS, epochs=mix.EPOCHS, least=mix.LEAST):
    """[(slot, source_key, key, epoch)] of (key, source, size) by running the schedule slot after slot."""
    queues = defaultdict(list)
    for key, source, size in rows:
        rank = hashlib.md5(f"{mix.SEED}{'' if key is None else key}".encode()).hexdigest()
        queues["" if source is None else f"={source}"].append((rank, key, max(1, size or 1)))
    totals = {k: sum(q[2] for q in queue) for k, queue in queues.items()}
    weights = weights_by_hand(totals, epochs, least, block)
    pools = Counter()
    for p, entity, _ in weights.values():
        pools[entity] += p
    everything = sum(pools.values())
    share = {e: p * slots // everything for e, p in pools.items()}
    order = sorted(pools, key=lambda e: (-(pools[e] * slots % everything), e))
    for e in order[: slots - sum(share.values())]:
        share[e] += 1
    clock = lambda k, x: (x + weights[k][2]) * pools[weights[k][1]] // weights[k][0]
    last = Counter()
    for k, t in totals.items():
        last[weights[k][1]] = max(last[weights[k][1]], clock(k, t - 1) // block)
    line, used = [], Counter()
    while not all(used[e] > last[e] for e in pools):
        t = len(line)
        ready = [e for e in pools if used[e] * slots // share[e] <= t]
        e = min(ready, key=lambda e: (-(-(used[e] + 1) * slots // share[e]), e))
        line.append((e, used[e]))
        used[e] += 1
    slot = {turn: t for t, turn in enumerate(line)}
    out = []
    for k, queue in queues.items():
        epoch, begin = 0, 0
        while (weights[k][1], clock(k, begin) // block) in slot:
            for _, key, cost in sorted(queue, key=lambda q: (q[0], q[1] is not None, q[1])):
                at = clock(k, begin)
                if (turn := (weights[k][1], at // block)) in slot:
                    out.append((slot[turn], at, k, key is not None, key, epoch))
                begin += cost
            epoch += 1
    return [(r[0], r[2], r[4], r[5]) for r in sorted(out, key=lambda r: r[:5])]


ROWS = [(i, f"s{0 if i % 10 else 1}" if i % 25 else None, i % 7 * 30 or None) for i in range(400)]
ROWS += [(1000 + i, f"tiny{i % 12}", 3 + i) for i in range(24)]
SCHEMA = "doc_id bigint, source string, n_chars bigint"


@pytest.mark.parametrize("least, epochs", [(99, 4), (20, 4), (8, 100), (20, 1)])
def test_schedule_by_hand(spark, least, epochs):
    found = mix.schedule(spark.createDataFrame(ROWS, SCHEMA), block=64, slots=100, least=least, epochs=epochs)
    rows = found.orderBy("slot", "clock", "source_key", "key").collect()
    want = by_hand(ROWS, 64, 100, epochs, least)
    assert [(r.slot, r.source_key, r.key, r.epoch) for r in rows] == want
    assert {r.key for r in rows} == {r[0] for r in ROWS}  # no document is lost
    assert max(Counter((r.key, r.epoch) for r in rows).values()) == 1
    owner = {}
    for r in rows:
        assert r.release <= r.slot < r.deadline
        assert owner.setdefault(r.slot, (r.entity, r.turn)) == (r.entity, r.turn)


def test_less_than_one_block_from_the_weights(spark):
    b = [61, 23, 9, 5, 1, 1]
    shares = spark.createDataFrame(list(enumerate(b)), "number int, share bigint")
    line = {r.slot: r.number for r in mix.period(shares, 100).collect()}
    assert sorted(line) == list(range(100))
    seen = Counter()
    for t in range(100):
        seen[line[t]] += 1
        assert all(abs(seen[i] - (t + 1) * x / 100) < 1 for i, x in enumerate(b))


def delivered(spark, docs, **options):
    """Input and delivered characters by source, and what the target weights give in as many slots."""
    totals = docs.groupBy(mix.source_key("source").alias("source_key")).agg(F.sum("n_chars").alias("total"))
    power = {r.source_key: r.power for r in mix.entities(mix.tempered(totals), options.get("block", mix.BLOCK)).collect()}
    uses = mix.schedule(docs, **options).persist()
    planned = (uses.agg(F.max("slot")).first()[0] + 1) * options.get("block", mix.BLOCK)
    uses = uses.join(docs.select(F.col("doc_id").alias("key"), "n_chars"), "key")
    got = {r.source_key: r.n for r in uses.groupBy("source_key").agg(F.sum("n_chars").alias("n")).collect()}
    aim = {k: planned * p / sum(power.values()) for k, p in power.items()}
    return {r.source_key: r.total for r in totals.collect()}, got, aim


@pytest.mark.parametrize("small", [100, 990, 5000])
def test_one_large_and_many_small_sources(spark, small):
    """Any number of sources: bounded output, delivered characters within a block or two of the weight."""
    cost = 100
    large = spark.range(9 * small).selectExpr("id as doc_id", "'large' as source", f"{cost} as n_chars")
    rest = spark.range(small).selectExpr("-1 - id as doc_id", "concat('s', id) as source", f"{cost} as n_chars")
    total, got, aim = delivered(spark, large.union(rest), block=400)
    assert set(got) == set(total)
    assert sum(got.values()) <= (mix.EPOCHS + 1) * sum(total.values())
    for k, n in got.items():
        # a thousandth of the mix is the grain of shares; then a block of the entity, one of the source, a document
        assert abs(n - aim[k]) <= sum(aim.values()) / mix.SLOTS + 2 * 400 + cost


def test_tiny_and_one_document_sources_keep_their_weight(spark):
    """A source of 1,000 characters, and one whose only document is long, beside two ordinary ones."""
    rows = [(i, "a" if i % 3 else "b", 800) for i in range(3000)] + [(5000, "tiny", 1000), (6000, "long", 1_600_000)]
    _, got, aim = delivered(spark, spark.createDataFrame(rows, SCHEMA))
    for k in got:  # a document is never cut, so one that has begun is delivered whole
        assert abs(got[k] - aim[k]) <= sum(aim.values()) / mix.SLOTS + 2 * mix.BLOCK + (1_600_000 if k == "=long" else 800)
    assert got["=tiny"] <= (mix.EPOCHS + 1) * 1000


def test_mixed_rows_keep_their_columns(odd, empty):
    out = mix.mixed(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert mix.mixed(empty).count() == 0 and mix.schedule(empty).count() == 0


def test_clashing_names_and_null_keys(spark):
    names = ("source_key", "entity", "slot", "clock", "row", "own", "key")
    docs = spark.createDataFrame([(None, None, 5), (None, "a", None), (2, "a", -3)], SCHEMA)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in names])
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.source) for r in out.collect()} == {(None, None), (None, "a"), (2, "a")}


def test_repeated_rows_travel_together(spark, odd):
    twice = mix.mixed(odd.union(odd))
    counts = Counter(r.doc_id for r in twice.collect())
    assert all(n % 2 == 0 for n in counts.values()) and len(counts) == odd.count()


def test_a_period_needs_a_slot_for_each_entity(empty):
    with pytest.raises(ValueError, match="slot for each"):
        mix.schedule(empty, slots=100)
