"""Near-duplicate lines by a segment-partition edit join.

Lines within `tau` edits of each other are linked; edits count UTF-8 bytes. A line of n bytes allows
min(2, n div 20) edits, by the shorter line of a pair. The shorter line is cut into tau + 1 segments, at
least one of which survives in the longer one, near its place. Each distinct line therefore indexes its
segments and probes the substrings of its own that could be a segment of a line of its length or up to two
less. Pairs that meet are verified by banded bit-parallel edit distance after their common ends are cut off.

A line is removed when an equal or linked line begins earlier (smaller doc_id, then earlier in the text),
judged on the input. Lines without a word are never removed. Null texts have no lines; null doc_ids come
first; rows that share a doc_id are copies of one document, whose equal lines at equal places stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import drop, durable, packed

EDITS = 2
BYTES_PER_EDIT = 20
WORD = r"[^\x20\x09-\x0D]"
#: Longest common ends are found by halving steps from here; longer ends only leave more to verify.
LONGEST_STEP = 20
#: The nine most frequent letters of English, whose numbers in a line are carried along, and the largest
#: number that is told apart.
COUNTED = "aehinorst"
MOST = 127
PLACE = "decimal(38,0)"


def place(key: Column, at: Column) -> Column:
    """Documents in order, lines in order within them, as one number."""
    number = F.coalesce(key.cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    return (number * F.lit(1 << 31).cast("decimal(11,0)") + at.cast("decimal(11,0)")).cast(PLACE)


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with a word: key, at, line (bytes), id (64-bit hash), place."""
    rows = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)))
    rows = rows.where(F.col("col").rlike(WORD))
    line = F.col("col").cast("binary")
    where = place(F.col("key"), F.col("pos")).alias("place")
    return rows.select("key", F.col("pos").alias("at"), line.alias("line"), F.xxhash64(line).alias("id"), where)


def allowed(length: str) -> str:
    """Edits that a line of this many bytes allows."""
    return f"least({EDITS}, {length} div {BYTES_PER_EDIT})"


def probes(tau: int, shorter: int) -> list[tuple[int, int]]:
    """(segment, shift) at which a line probes lines `shorter` bytes less, if those allow `tau` edits.

    A surviving segment can be chosen so that the edits to its left explain its shift, and those to its
    right explain the rest of the difference in length.
    """
    out = []
    for i in range(tau + 1):
        low = max(-i, shorter - (tau - i))
        high = min(i, shorter + (tau - i))
        out += [(i, shift) for shift in range(low, high + 1)]
    return out


def letter_numbers(line: str) -> Column:
    """How often each counted letter occurs, seven bits each. One edit changes the sum of all by two at most."""
    text = F.col(line).cast("string")
    out = F.lit(0).cast("long")
    for i, c in enumerate(COUNTED):
        n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(F.least(n, F.lit(MOST)).cast("long"), 7 * i))
    return out


def number_difference(a: str, b: str) -> Column:
    """Sum of differences of the letter numbers of two lines."""
    total = F.lit(0).cast("long")
    for i in range(len(COUNTED)):
        one, two = (F.shiftright(F.col(c), 7 * i).bitwiseAND(F.lit(MOST).cast("long")) for c in (a, b))
        total = total + F.abs(one - two)
    return total


def keyed(distinct: DataFrame, indexed: bool) -> DataFrame:
    """(key, id, letters) of distinct lines (id, line, n, letters): indexed segments, or the other substrings they probe.

    Indexed segments also probe lines as long as their own. Lines are crossed with the list of probes, so
    one short expression makes all keys. Of tau + 1 segments the last ones take the remainder.
    """
    chosen = [
        F.struct(*[F.lit(x).alias(c) for c, x in zip(("tau", "shorter", "i", "shift"), (tau, shorter, i, shift))])
        for tau in range(1, EDITS + 1)
        for shorter in range(tau + 1)
        for i, shift in probes(tau, shorter)
        if (shorter == 0 and shift == 0) == indexed
    ]
    rows = distinct.select("id", "letters", "line", F.col("n").cast("int").alias("n"), F.explode(F.array(*chosen)).alias("c"))
    rows = rows.select("id", "letters", "line", "n", "c.tau", "c.i", "c.shift", F.expr("n - c.shorter").alias("length"))
    rows = rows.where(F.expr(f"{allowed('length')} = tau"))
    size = "int(length div (tau + 1))"
    rest = "(tau + 1 - length % (tau + 1))"
    rows = rows.select(
        "id", "letters", "line", "n", "i", "length",
        F.expr(f"1 + i * {size} + greatest(0, i - {rest}) + shift").alias("begin"),
        F.expr(f"{size} + if(i >= {rest}, 1, 0)").alias("size"),
    )
    rows = rows.where("begin >= 1 and begin + size - 1 <= n")
    return rows.select(F.expr("xxhash64(length, i, substring(line, begin, size))").alias("key"), "id", "letters")


def candidates(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of line ids that share a segment; `distinct` has id, line, n, its bytes, and letters.

    Pairs whose letters differ too much in number are not made: in a group of near copies that share a
    segment, that leaves few beside the true ones.
    """
    index = keyed(distinct, True)
    probe = index.withColumn("indexed", F.lit(True)).unionByName(
        keyed(distinct, False).withColumn("indexed", F.lit(False))
    )
    a = index.select("key", F.col("id").alias("a"), F.col("letters").alias("letters_a"))
    b = probe.select("key", F.col("id").alias("b"), F.col("letters").alias("letters_b"), "indexed")
    # lines of equal length meet from both sides under indexed keys; one side is enough
    close = number_difference("letters_a", "letters_b") <= 2 * EDITS
    met = b.join(a, (b["key"] == a["key"]) & close & F.expr("a != b and (not indexed or a < b)"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common(a: str, b: str, limit: str) -> str:
    """Bytes that two binaries have in common at their beginning, up to a limit."""
    steps = ", ".join(str(1 << s) for s in range(LONGEST_STEP, -1, -1))
    return f"""aggregate(array({steps}), 0, (got, s) -> if(got + s <= {limit}
        and substring({a}, got + 1, s) = substring({b}, got + 1, s), got + s, got))"""


def banded(a: str, b: str, tau: int) -> str:
    """Edit distance of two binaries of which `a` is no longer than `b` and at most `tau` shorter.

    Bit v of a vector stands for byte i - tau + v of `a` while byte i of `b` is read, so a band of
    2 * tau + 1 cells is one number. Vertical and horizontal differences are kept as bits. The score follows
    the lower edge of the band to the last row, never falling, and then that row, at most 2 * tau steps, so
    steps beyond 3 * tau edits are passed over. Exact up to `tau`, larger beyond.
    Equal bytes put ahead of both keep the band off the corner without changing the distance.
    """
    width, full = 2 * tau + 1, (1 << (2 * tau + 1)) - 1
    same = " + ".join(
        f"if(s.i - {tau} + {v} >= 0 and substring(s.a, s.i - {tau} + {v} + 1, 1) = substring(s.b, s.i + 1, 1), {1 << v}, 0)"
        for v in range(width)
    )
    diagonal = f"if(r.d0 & {1 << (2 * tau)} = 0, 1, 0)"
    edge = f"shiftleft(1, {2 * tau - 1} - (s.i - (s.m - {tau})))"
    last_row = f"if(r.hp & {edge} != 0, 1, 0) - if(s.vp & r.d0 & {edge} != 0, 1, 0)"
    return f"""aggregate(sequence(0, cast(length({b}) as int) + {tau}),
        named_struct('a', concat(cast(repeat('=', {tau + 1}) as binary), {a}),
                     'b', concat(cast(repeat('=', {tau + 1}) as binary), {b}),
                     'm', cast(length({a}) as int) + {tau + 1}, 'i', 0,
                     'vp', {full & ~((1 << tau) - 1)}, 'vn', 0, 'score', {tau}),
        (s, step) -> if(s.score > {3 * tau}, s, transform(transform(transform(array({same}),
            eq -> named_struct('d0', ((((eq & s.vp) + s.vp) ^ s.vp) | eq | s.vn) & {full})),
            r -> named_struct('d0', r.d0, 'hp', (s.vn | ~(r.d0 | s.vp)) & {full})),
            r -> named_struct('a', s.a, 'b', s.b, 'm', s.m, 'i', s.i + 1,
                'vp', ((s.vp & r.d0) | ~(shiftright(r.d0, 1) | r.hp)) & {full},
                'vn', shiftright(r.d0, 1) & r.hp,
                'score', s.score + if(s.i < s.m - {tau}, {diagonal}, {last_row})))[0]),
        s -> s.score)"""


def with_distance(pairs: DataFrame, tau: int = EDITS) -> DataFrame:
    """Adds `distance`, exact up to tau, to binaries x and y whose lengths differ by at most tau."""
    rows = pairs.withColumn("short", F.expr("if(length(x) <= length(y), x, y)"))
    rows = rows.withColumn("long", F.expr("if(length(x) <= length(y), y, x)"))
    rows = rows.withColumn("head", F.expr(common("short", "long", "length(short)")))
    cut = "cast({0} as int)"
    for side in ("short", "long"):
        rows = rows.withColumn(side, F.expr(f"substring({side}, {cut.format('head + 1')})"))
    for side in ("short", "long"):  # bytes backwards, by way of single-byte characters
        rows = rows.withColumn(f"{side}_back", F.expr(f"encode(reverse(decode({side}, 'ISO-8859-1')), 'ISO-8859-1')"))
    rows = rows.withColumn("tail", F.expr(common("short_back", "long_back", "length(short)")))
    for side in ("short", "long"):
        rows = rows.withColumn(side, F.expr(f"substring({side}, 1, cast(length({side}) - tail as int))"))
    near = F.expr(f"if(length(short) = 0, cast(length(long) as int), {banded('short', 'long', tau)})")
    return rows.withColumn("distance", near).drop("short", "long", "head", "tail", "short_back", "long_back")


def links(docs: DataFrame, firsts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, first_a, first_b) of all pairs of distinct lines within their allowed edits.

    `firsts` has (id, first) of each distinct line. Texts of lines are shuffled twice: when the first of
    equal lines is taken, by its place so that no line is hot, and when candidates look up their lines.
    """
    spark = docs.sparkSession
    lines = lines_of(docs, key, text).select("id", "place", "line").where(F.length("line") >= BYTES_PER_EDIT)
    one = firsts.select(F.col("id").alias("own"), "first")
    lines = lines.join(one, (lines["id"] == one["own"]) & (lines["place"] == one["first"]))
    distinct = packed(
        lines.select("id", "first", "line", F.length("line").alias("n"), letter_numbers("line").alias("letters")),
        "distinct-lines",
    )
    pairs = durable(candidates(distinct), "line-candidates")
    named = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    # the same plan at every size, whether or not so many ids could be broadcast
    told = packed(distinct.join(named.hint("merge"), "id").select("id", "first", "line"), "candidate-lines")
    a, b = (told.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "line", "first")]) for s in "ab")
    found = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b"))
    found = with_distance(found.withColumn("x", F.col("line_a")).withColumn("y", F.col("line_b")))
    limit = F.expr(allowed("least(length(x), length(y))")).alias("limit")
    # stored ahead of the condition, which would otherwise be pushed down and repeat the whole expression
    measured = durable(found.select("a", "b", "first_a", "first_b", "distance", limit), "line-distances")
    drop(distinct, pairs, told)
    return measured.where("distance <= limit").select("a", "b", "first_a", "first_b").distinct()


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with lines: n_lines, n_exact, n_near, n_links and `removed`, the places of lines that go.

    n_exact counts lines that occur earlier, n_near others whose linked line begins earlier, n_links the
    links of a document's lines.
    """
    lines = durable(lines_of(docs, key, text).drop("line"), "lines")
    firsts = durable(lines.groupBy("id").agg(F.min("place").alias("first")), "first-lines")
    pairs = links(docs, firsts, key, text)
    ends = pairs.selectExpr("a as id", "first_a as own", "first_b as other").union(
        pairs.selectExpr("b as id", "first_b as own", "first_a as other")
    )
    near = ends.groupBy("id").agg(F.max(F.col("other") < F.col("own")).alias("near"), F.count("*").alias("n_links"))
    rows = lines.select("key", "at", "id", "place").join(firsts, "id").join(near, "id", "left")
    exact = F.col("place") != F.col("first")
    near_first = ~exact & F.coalesce("near", F.lit(False))
    return rows.groupBy("key").agg(
        F.count("*").alias("n_lines"),
        F.sum(exact.cast("long")).alias("n_exact"),
        F.sum(near_first.cast("long")).alias("n_near"),
        F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.sort_array(F.collect_set(F.when(exact | near_first, F.col("at")))).alias("removed"),
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """The documents without their removed lines and with sizes to match; texts left without a word go.

    Removed lines of a document are marked in one array of its length, so each text is walked once.
    """
    found = decisions(docs, key, text).where(F.size("removed") > 0)
    found = found.select(F.col("key").alias("own_key"), F.col("removed").alias("gone"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(key).alias("own")).join(found, F.col("own").eqNullSafe(F.col("own_key")), "left")
    marks = F.expr("map_from_arrays(gone, transform(gone, x -> true))")
    rows = rows.withColumn("marks", marks)
    kept = F.expr(f"array_join(filter(split(row.`{text}`, '\\n', -1), (x, i) -> marks[i] is null), '\\n')")
    whole = F.col("gone").isNull()
    rows = rows.withColumn("kept", F.when(whole, F.col(f"row.`{text}`")).otherwise(kept))
    rows = rows.where(whole | F.col("kept").rlike(WORD))
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == text:
            value = F.col("kept")
        elif name == size:
            value = F.when(whole, value).otherwise(F.length("kept").cast(docs.schema[name].dataType))
        columns.append(value.alias(name))
    return rows.select(*columns)
