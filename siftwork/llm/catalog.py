"""One query per operator over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import (
    audit,
    automata,
    chat,
    heaps,
    langid,
    lines,
    maxent,
    mix,
    pack,
    pieces,
    quality,
    simhash,
    syncmers,
)

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(spark_key: str, parts: int, rest: int):
    """Whether the CRC of a key leaves this rest; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(spark_key).cast("string").cast("binary")) % parts == rest, F.lit(False))


def op1_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    known = docs.where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.fit(known.select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), langid.identify(docs, model).alias("found"))
    return rows.select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", F.size("found.spans").alias("n_spans")
    )


def op2_mix(spark: SparkSession, folder: str) -> DataFrame:
    uses = mix.schedule(table(spark, folder, "documents"))
    source = F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)")).alias("source")
    return uses.select(
        F.col("key").alias("doc_id"), source, "epoch", "turn", "slot", "release", "deadline", "clock", "begin"
    )


def op3_maxent(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").alias("key"), held_out("doc_id", 5, 1).alias("flag"), text)
    training = rows.where(~F.col("flag")).select("key", "text")
    counts_table, counts = maxent.gather(training)
    found = maxent.score(rows, counts_table, maxent.train(training, counts))
    return found.select(
        F.col("key").alias("doc_id"), F.col("flag").alias("held_out"), "n_tokens", "n_known", "train_tokens",
        F.col("base").alias("base_score"), "score",
    )


def op4_automata(spark: SparkSession, folder: str) -> DataFrame:
    found = automata.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = lines.decisions(docs).withColumnRenamed("key", "doc_id")
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_exact", "n_near", "n_links")]
    return rows.select("doc_id", *counts, F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    out = chat.conversations(chat.chains(turns.union(extra)))
    read = out.select("conv", "formatted", "loss", chat.turns_of("formatted").alias("turns"))
    line = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text("formatted", "loss")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack.pack(table(spark, folder, "documents"), tokenizer_path())


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.stored_ledger(table(spark, folder, "documents"))
    report = quality.ablation_report(rows)
    base = F.col("failures").bitwiseAND(F.lit(quality.mask(quality.BASE_RULES))) != 0
    earlier = [quality.passes(v).alias(f"kept_v{v}") for v in quality.POLICIES if v != quality.CURRENT]
    return rows.join(F.broadcast(report)).select(  # one row
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "alpha_words", "failures",
        base.alias("base_failed"), quality.passes().alias("kept"),
        *earlier, quality.only_rule().alias("only_rule"), "ablation",
    )


def op10_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    rows = syncmers.edited_pairs(table(spark, folder, "documents"))
    return rows.select(
        F.col("key").alias("doc_id"), "n_chars", "edited_sha256",
        syncmers.as_text("sketch").alias("fingerprint"),
        syncmers.as_text("edited_sketch").alias("edited_fingerprint"),
        syncmers.likeness("sketch", "edited_sketch").alias("near_edited"),
        syncmers.likeness("sketch", "next_sketch").alias("near_next"),
    )


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces.encode(table(spark, folder, "documents"), tokenizer_path(PIECES), decoded=True)
    return rows.select(
        F.col("key").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_heaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = heaps.cluster(table(spark, folder, "embeddings"))
    return rows.select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )


def op13_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_mix": op2_mix,
    "op3_maxent": op3_maxent,
    "op4_automata": op4_automata,
    "op5_lines": op5_lines,
    "op6_chat": op6_chat,
    "op7_simhash": op7_simhash,
    "op8_pack": op8_pack,
    "op9_quality": op9_quality,
    "op10_syncmers": op10_syncmers,
    "op11_pieces": op11_pieces,
    "op12_heaps": op12_heaps,
    "op13_audit": op13_audit,
}

OP9 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM places),
covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS p FROM grams WHERE c > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measured AS (
  SELECT docs.doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS alpha_words
  FROM docs LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words OR word_chars > 25 * n_words)::BIGINT
    + 32 * (100 * alpha_words < 60 * n_words)::BIGINT AS failures
  FROM measured),
rules AS (SELECT unnest(['short', 'repeated', 'symbols', 'duplicate_lines', 'word_length', 'letters']) AS rule,
                 unnest([1, 2, 4, 8, 16, 32]) AS bit),
patterns AS (SELECT failures, count(*) AS n FROM judged GROUP BY failures),
ablated AS (
  SELECT rule, coalesce(sum(n) FILTER (failures & bit <> 0), 0)::BIGINT AS rejects,
         coalesce(sum(n) FILTER (failures = bit), 0)::BIGINT AS alone,
         coalesce(sum(n) FILTER (failures & ~bit = 0), 0)::BIGINT AS without
  FROM patterns, rules GROUP BY rule)
SELECT judged.*, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures & 1 = 0 AS kept_v0,
       failures & 3 = 0 AS kept_v1, (SELECT rule FROM rules WHERE bit = failures) AS only_rule,
       (SELECT string_agg(rule || ':' || rejects || ':' || alone || ':' || without, ',' ORDER BY rule) FROM ablated) AS ablation
FROM judged
"""

OP2 = """
WITH RECURSIVE sums AS (
  SELECT source, doc_id, sum(greatest(coalesce(n_chars, 1), 1))::BIGINT AS cost
  FROM documents GROUP BY ALL),
placed AS (
  SELECT *, (coalesce(sum(cost) OVER (PARTITION BY source ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begin
  FROM sums),
totals AS (
  SELECT source, coalesce('=' || source, '') AS k, sum(cost)::BIGINT AS total,
         floor(sqrt(sum(cost)::DOUBLE * sqrt(sum(cost)::DOUBLE)) * 1000)::HUGEINT AS free
  FROM sums GROUP BY source),
powers AS (
  SELECT source, k, total,
         greatest(least(free, 4 * total::HUGEINT * (max(free) OVER ()) // (max(total) OVER ())), 1) AS power
  FROM totals),
weighed AS (SELECT *, sum(power) OVER ()::HUGEINT AS everything FROM powers),
light AS (
  SELECT coalesce(sum(power) FILTER (power * 200 < everything), 0)::HUGEINT AS together,
         min({'power': power, 'k': k}) FILTER (power * 200 >= everything) AS next
  FROM weighed),
named AS (
  SELECT weighed.*, CASE WHEN power * 200 < everything OR (together > 0 AND together * 200 < everything AND k = next.k)
                         THEN '*' ELSE k END AS entity
  FROM weighed, light),
sources AS (
  SELECT *, sum(power) OVER (PARTITION BY entity)::HUGEINT AS pool,
         CASE WHEN entity = '*' THEN ('0x' || substr(md5('mix' || k), 1, 8))::BIGINT % least(total, 16384) ELSE 0 END AS phase
  FROM named),
pools AS (
  SELECT entity, any_value(pool) AS pool, any_value(everything) AS everything,
         max(((total - 1 + phase)::HUGEINT * pool // power) // 16384)::BIGINT AS last
  FROM sources GROUP BY entity),
parts AS (
  SELECT *, pool * 1000 // everything AS part,
         row_number() OVER (ORDER BY pool * 1000 % everything DESC, entity) AS place
  FROM pools),
shares AS (
  SELECT *, (part + (place <= 1000 - sum(part) OVER ())::INT)::BIGINT AS share,
         row_number() OVER (ORDER BY entity) AS number
  FROM parts),
b AS (SELECT list(share ORDER BY number) AS b FROM shares),
steps AS (
  SELECT -1::BIGINT AS slot, list_transform(b, lambda x: 0::BIGINT) AS done, 0::BIGINT AS number FROM b
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: x + (i = pick)::BIGINT), pick FROM (
    SELECT slot, done, list_min(list_filter(list_transform(done, lambda x, i:
      CASE WHEN x < b[i] AND (x * 1000) // b[i] <= slot + 1
           THEN (((x + 1) * 1000 + b[i] - 1) // b[i]) * 10000 + i END), lambda v: v IS NOT NULL)) % 10000 AS pick
    FROM steps, b WHERE slot < 999)),
one AS (SELECT slot, number, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS turn FROM steps WHERE slot >= 0),
finish AS (SELECT max((last // share) * 1000 + slot) AS finish FROM shares JOIN one
           ON one.number = shares.number AND one.turn = last % share),
used AS (SELECT number, sum((finish - slot + 1000) // 1000)::BIGINT AS used FROM one, finish GROUP BY number),
facts AS (
  SELECT sources.*, share, s.number, (used::HUGEINT * 16384 * power - 1) // sources.pool - phase AS upto
  FROM sources JOIN shares s ON s.entity = sources.entity JOIN used ON used.number = s.number),
uses AS (
  SELECT doc_id, f.*, begin, unnest(range(0, ((upto - begin) // total)::BIGINT + 1)) AS epoch
  FROM placed JOIN facts f ON placed.source IS NOT DISTINCT FROM f.source),
clocks AS (
  SELECT *, ((begin + epoch * total + phase)::HUGEINT * pool // power)::BIGINT AS clock, clock // 16384 AS w FROM uses)
SELECT doc_id, source, epoch, w AS turn,
       (w // share) * 1000 + slot AS slot,
       (w // share) * 1000 + (one.turn * 1000) // share AS release,
       (w // share) * 1000 + ((one.turn + 1) * 1000 + share - 1) // share AS deadline, clock, begin
FROM clocks JOIN one ON one.number = clocks.number AND one.turn = w % share
"""

OP5 = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
lines AS (SELECT * FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, strlen(line) AS n, min((doc_id, pos)) AS first FROM lines GROUP BY line),
pairs AS (
  SELECT a.line AS a, b.line AS b, a.first AS first_a, b.first AS first_b
  FROM (SELECT *, unnest([n, n + 1, n + 2]) AS other FROM firsts) a JOIN firsts b ON b.n = a.other
  WHERE (b.n > a.n OR b.line > a.line) AND a.n >= 20 AND b.n - a.n <= least(2, a.n // 20)
    AND levenshtein(a.line, b.line) <= least(2, a.n // 20)),
ends AS (SELECT a AS line, first_b < first_a AS earlier FROM pairs
         UNION ALL SELECT b, first_a < first_b FROM pairs),
near AS (SELECT line, bool_or(earlier) AS near, count(*) AS n_links FROM ends GROUP BY line),
judged AS (
  SELECT doc_id, pos, (doc_id, pos) <> first AS exact, coalesce(near, false) AND (doc_id, pos) = first AS near,
         coalesce(n_links, 0) AS n_links
  FROM lines JOIN firsts USING (line) LEFT JOIN near USING (line)),
found AS (
  SELECT doc_id, count(*) AS n_lines, sum(exact::INT) AS n_exact, sum(near::INT) AS n_near, sum(n_links) AS n_links,
         coalesce(string_agg(CASE WHEN exact OR near THEN pos::VARCHAR END, ',' ORDER BY pos), '') AS removed
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact,
       coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(removed, '') AS removed
FROM documents LEFT JOIN found USING (doc_id)
"""

OP6 = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
framed AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:INST\]|ROLE|s>))', '\1/\2\3', 'g')) AS n FROM said),
sized AS (
  SELECT *, n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END AS chars FROM framed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM d),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counted AS (
  SELECT part, a, b, c, d, e, count(*)::BIGINT AS n, sum(coalesce(good, 0))::BIGINT AS good,
         sum(coalesce(toxic, 0))::BIGINT AS toxic,
         concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END,
                CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE l2.x <> l1.x AND l3.x NOT IN (l1.x, l2.x) AND l4.x NOT IN (l1.x, l2.x, l3.x)
    AND l5.x NOT IN (l1.x, l2.x, l3.x, l4.x)),
steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS ahead, filter_order[1:step] AS upto
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
met AS (
  SELECT *, contains(fails, f) AS hit,
         len(list_filter(string_split(fails, ''), lambda x: x <> '' AND contains(ahead, x))) > 0 AS gone
  FROM counted, steps),
found AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM found
"""

OP12 = r"""
WITH RECURSIVE kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
seeds AS (
  SELECT v, row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id, v) - 1 AS cluster
  FROM kept QUALIFY cluster < 40),
rounds AS (
  SELECT 0 AS round, (SELECT list(v ORDER BY cluster) FROM seeds) AS c
  UNION ALL
  SELECT round + 1, (
    SELECT list(coalesce(m.mean, o.v) ORDER BY o.cluster)
    FROM (SELECT unnest(rounds.c) AS v, unnest(range(0, len(rounds.c))) AS cluster) o
    LEFT JOIN (
      SELECT cluster, list(q ORDER BY i) AS mean FROM (
        SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS q
        FROM (SELECT cluster, unnest(v) AS x, unnest(range(0, 64)) AS i FROM (
          SELECT v, list_position(ds, list_min(ds)) - 1 AS cluster FROM (
            SELECT v, list_transform(rounds.c, lambda a: list_sum(list_transform(list_zip(a, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS ds
            FROM kept)))
        GROUP BY cluster, i)
      GROUP BY cluster) m USING (cluster))
  FROM rounds WHERE round < 5),
final AS (SELECT c FROM rounds WHERE round = 5),
placed AS (
  SELECT vec_id, (list_position(ds, list_min(ds)) - 1)::INT AS cluster, list_min(ds)::BIGINT AS distance, c
  FROM (SELECT vec_id, c, list_transform(c, lambda a: list_sum(list_transform(list_zip(a, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS ds
        FROM kept, final))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c[cluster + 1], lambda x: x::VARCHAR), ',')) AS centroid_sha256
FROM placed
"""

SQL = {"op12_heaps": OP12, "op13_audit": OP13, "op6_chat": OP6, "op2_mix": OP2, "op5_lines": OP5, "op9_quality": OP9}
