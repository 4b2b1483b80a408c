"""Mixing sources to target weights by Pfair scheduling.

Each source's documents stand in a seeded order; the running offset of a document is what its source has
delivered before it, over all epochs, and a block is 16,384 of that. Target weights are sizes to the power
3/4, held back so that no source is used more than `EPOCHS` times as often as the largest one. A period of
`SLOTS` slots gives each entity a whole number of blocks by its weight; the j-th of b blocks is released at
slot floor(j * SLOTS / b) and due by ceil((j + 1) * SLOTS / b). The earliest deadline among released blocks
runs in each slot, so after any number of slots every entity is less than one block away from its weight.
The period repeats until every source has been used whole; sources that end earlier begin again, so no
document is lost and the weights hold over the whole result.

An entity is a source with at least one `LEAST`-th of all weight. Lighter sources, of which there may be any
number, share one entity (with the lightest other source if they weigh too little together). Each of them
runs on the entity's clock: its offsets, begun at a seeded phase within its first block, are stretched by the
entity's weight over its own, so it keeps its weight to within a block beside that of its entity. A document
starts in its block and may reach beyond it.

Rows that share source and doc_id travel as one unit. A null source is a source of its own; a null, zero or
negative size counts as one. Ties in the seeded order go by doc_id. An empty table gives an empty result.
Texts are not looked at, so long ones count by their size alone. `schedule` reads three columns and returns its
own, and `mixed` keeps those of the input in a struct, so further columns with any names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.ship import durable

SLOTS = 1000
BLOCK = 16384
SEED = "mix"
BUCKET_DIGITS = 3
#: How many times as often as the largest source another one may be used.
EPOCHS = 4
#: Sources lighter than this part of the whole share one entity.
LEAST = 200
#: The name of that entity, which no source_key equals.
SHARED = "*"


def source_key(source: str) -> Column:
    """A key that joins null sources as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def whole(column: str) -> str:
    """A number whose products with others don't overflow."""
    return f"cast({column} as decimal(19,0))"


def units(docs: DataFrame, source: str = "source", key: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """One row per document: source_key, key, cost, its seeded rank and the bucket of that rank."""
    cost = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1))
    rows = docs.select(source_key(source).alias("source_key"), F.col(key).alias("key"), cost.alias("cost"))
    rows = rows.groupBy("source_key", "key").agg(F.sum("cost").alias("cost"))
    rank = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    return rows.withColumn("rank", rank).withColumn("bucket", F.substring("rank", 1, BUCKET_DIGITS))


def offsets(rows: DataFrame) -> DataFrame:
    """Adds `begin`, the cost ahead of a unit in its source.

    Sums over buckets of the rank come first, so a source is never ordered in one task.
    """
    sums = rows.groupBy("source_key", "bucket").agg(F.sum("cost").alias("total"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("source_key", "bucket")
        .orderBy("rank", "key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    begin = F.col("base") + F.coalesce(F.sum("cost").over(inside), F.lit(0))
    return rows.join(sums, ["source_key", "bucket"]).withColumn("begin", begin)


def tempered(totals: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Adds `power`, the target weight of each source: its size to the power 3/4.

    `totals` has source_key and total. No power is more than `epochs` times what the largest source's
    rate of use would give.
    """
    power = F.floor(F.sqrt(F.col("total").cast("double") * F.sqrt(F.col("total").cast("double"))) * 1000)
    rows = totals.withColumn("power", power.cast("long"))
    top = rows.agg(F.max("power").alias("top_power"), F.max("total").alias("top_total"))
    rows = rows.join(F.broadcast(top))  # one row
    most = F.expr(f"{whole('total')} * {epochs} * {whole('top_power')} div top_total")
    return rows.withColumn("power", F.greatest(F.least("power", most), F.lit(1))).drop("top_power", "top_total")


def entities(rows: DataFrame, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """Adds entity, pool (the entity's power) and phase to sources with their powers."""
    everything = rows.agg(F.sum("power").alias("all"))
    rows = rows.join(F.broadcast(everything))  # one row
    rows = rows.withColumn("light", F.expr(f"{whole('power')} * {least} < `all`"))
    lightest = rows.agg(
        F.coalesce(F.sum(F.when(F.col("light"), F.col("power"))), F.lit(0)).alias("together"),
        F.min(F.when(~F.col("light"), F.struct("power", "source_key"))).alias("next"),
    )
    rows = rows.join(F.broadcast(lightest))  # one row
    lacking = F.expr(f"together > 0 and {whole('together')} * {least} < `all` and source_key = next.source_key")
    rows = rows.withColumn("entity", F.when(F.col("light") | lacking, F.lit(SHARED)).otherwise(F.col("source_key")))
    pools = rows.groupBy("entity").agg(F.sum("power").alias("pool"))
    rows = rows.join(F.broadcast(pools), "entity")  # one row per entity, at most `least` + 1
    seeded = f"cast(conv(substring(md5(concat('{SEED}', source_key)), 1, 8), 16, 10) as bigint)"
    phase = F.expr(f"if(entity = '{SHARED}', {seeded} % least(total, {block}), 0L)")
    return rows.select("source_key", "total", "power", "entity", "pool", phase.alias("phase"))


def shares_of(pools: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(entity, number, share) of entities with their pools, by largest remainders: shares sum to `slots`.

    There are at most `LEAST` + 1 entities, so their order is a small one.
    """
    everything = pools.agg(F.sum("pool").alias("all"))
    rows = pools.join(F.broadcast(everything))  # one row
    rows = rows.withColumn("part", F.expr(f"{whole('pool')} * {slots} div `all`"))
    rows = rows.withColumn("rest", F.expr(f"{whole('pool')} * {slots} % `all`"))
    order = Window.orderBy(F.col("rest").desc(), "entity")
    given = F.row_number().over(order) <= F.lit(slots) - F.sum("part").over(Window.partitionBy())
    rows = rows.withColumn("share", F.col("part") + F.when(given, 1).otherwise(0))
    return rows.select("entity", (F.row_number().over(Window.orderBy("entity")) - 1).alias("number"), "share")


def period(shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(number, turn, slot): the slot of each entity's blocks in one period, earliest deadline first.

    One row of `slots` steps; its size is a parameter and doesn't depend on the data.
    """
    row = shares.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "share"))), lambda x: x["share"])
                     .alias("b"))
    pick = f"""array_min(filter(transform(b, (x, i) -> if(
        acc.done[i] < x and (acc.done[i] * {slots}) div x <= t,
        struct(((acc.done[i] + 1) * {slots} + x - 1) div x as due, i as i), null)), x -> x is not null)).i"""
    step = f"""transform(array({pick}), p -> struct(
        transform(acc.done, (x, i) -> if(i = p, x + 1, x)) as done, concat(acc.line, array(p)) as line))[0]"""
    line = f"""aggregate(sequence(0L, {slots - 1}L),
        struct(transform(b, x -> 0L) as done, cast(array() as array<int>) as line),
        (acc, t) -> {step}, acc -> acc.line)"""
    rows = row.where(F.size("b") > 0).select(F.posexplode(F.expr(line)).alias("slot", "number"))
    turn = F.row_number().over(Window.partitionBy("number").orderBy("slot")) - 1
    return rows.select("number", turn.cast("long").alias("turn"), F.col("slot").cast("long").alias("slot"))


def schedule(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    size: str = "n_chars",
    block: int = BLOCK,
    slots: int = SLOTS,
    epochs: int = EPOCHS,
    least: int = LEAST,
) -> DataFrame:
    """Every use of every document: source_key, key, epoch, entity, turn, slot, release, deadline, clock, begin.

    The result in the order (slot, clock, source_key, key) is the mix. Broadcast are the entities, at most
    `least` + 1, and the slots of a period. Facts of sources are stored: one row for each, joined without a hint.
    """
    if least + 1 > slots:
        raise ValueError("a period needs a slot for each entity")
    rows = units(docs, source, key, size)
    totals = durable(rows.groupBy("source_key").agg(F.sum("cost").alias("total")), "mix-totals")
    named = entities(tempered(totals, epochs), block, least)
    last = F.expr(f"({whole('total - 1 + phase')} * {whole('pool')} div power) div {block}")
    named = durable(named.withColumn("last", last), "mix-sources")
    pools = named.groupBy("entity").agg(F.first("pool").alias("pool"), F.max("last").alias("last"))
    shares = shares_of(pools.select("entity", "pool"), slots).join(pools, "entity")
    shares = durable(shares, "mix-entities")
    one = durable(period(shares.select("number", "share"), slots), "mix-period")
    # the slot of the last block that any source needs ends the mix
    need = shares.withColumn("turn", F.expr("last % share")).join(F.broadcast(one), ["number", "turn"])
    end = need.agg(F.max(F.expr(f"(last div share) * {slots} + slot")).alias("end"))
    upto = one.join(F.broadcast(end)).groupBy("number").agg(
        F.sum(F.expr(f"(end - slot + {slots}) div {slots}")).alias("used")
    )
    used = shares.select("entity", "number", "share").join(upto, "number")
    facts = named.drop("last").join(F.broadcast(used), "entity")
    limit = F.expr(f"({whole('used')} * {block} * {whole('power')} - 1) div pool - phase")
    rows = offsets(rows).join(facts.withColumn("limit", limit), "source_key")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (limit - begin) div total)")))
    rows = rows.withColumn("clock", F.expr(f"{whole('begin + epoch * total + phase')} * {whole('pool')} div power"))
    rows = rows.withColumn("whole_turn", F.expr(f"clock div {block}"))
    rows = rows.withColumn("turn", F.expr("whole_turn % share")).withColumn("round", F.expr("whole_turn div share"))
    rows = rows.join(F.broadcast(one), ["number", "turn"])
    return rows.select(
        "source_key",
        "key",
        "epoch",
        "entity",
        F.col("whole_turn").alias("turn"),
        F.expr(f"round * {slots} + slot").alias("slot"),
        F.expr(f"round * {slots} + (turn * {slots}) div share").alias("release"),
        F.expr(f"round * {slots} + ((turn + 1) * {slots} + share - 1) div share").alias("deadline"),
        "clock",
        "begin",
    )


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """The documents in the order of the mix, with the columns they came with; further epochs repeat rows."""
    uses = schedule(docs, source, key, size).select("source_key", "key", "slot", "clock")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, source_key(source).alias("own_source"), F.col(key).alias("own"))
    same = (rows["own_source"] == uses["source_key"]) & rows["own"].eqNullSafe(uses["key"])
    return rows.join(uses, same).orderBy("slot", "clock", "source_key", "own").select("row.*")
