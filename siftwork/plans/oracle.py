"""The queries of ``queries.py`` as SQL over the same tables, written independently of Spark."""

from __future__ import annotations

from collections.abc import Sequence

from siftwork.functions.stopwords import ENGLISH
from siftwork.plans.queries import (
    COLUMNS,
    EXAMPLE_ID,
    FIXED_MODEL,
    ION,
    NEAR,
    RARE_SEARCH,
    REFERENCE_TEXT,
    SAMPLE_EXTRA_ID,
    SAMPLE_SEED,
    SEARCH,
    SECOND_MODEL,
    SESSION_MODEL,
    SPECS,
    THE,
    VIEW_ID,
)
from siftwork.specs import KeywordFeature

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count_of(keywords: Sequence[str], text: str = "text") -> str:
    parts = [
        f"(length(lower({text})) - length(replace(lower({text}), {quoted(k.lower())}, '')))"
        f" / {len(k)}.0::DOUBLE"
        for k in keywords
        if k.strip()
    ]
    return "(" + " + ".join(parts) + ")"


def listed(spec: KeywordFeature) -> str:
    """A keyword feature among all features: the weight enters twice."""
    return f"{count_of(spec.keywords)} * {spec.weight**2}::DOUBLE AS _{spec.name}"


FEATURES = ", ".join(listed(s) for s in SPECS)
FEATURED = f"featured AS (SELECT *, {FEATURES} FROM documents)"


def logistic(model) -> str:
    terms = [f"{c}::DOUBLE * {f}" for f, c in zip(model.features, model.coefficients)]
    return f"1 / (1 + exp(-({model.intercept}::DOUBLE + {' + '.join(terms)})))"


SCORED = f"{FEATURED}, scored AS (SELECT *, {logistic(FIXED_MODEL)} AS _pred FROM featured)"

POSITION = (
    f"('0x' || substr(md5(doc_id::VARCHAR || '|' || '{SAMPLE_SEED}'), 1, 15))::BIGINT"
)
SAMPLE = f"""sample AS (
    SELECT CASE WHEN (SELECT count(*) FROM documents) <= 100 THEN doc_id ELSE {POSITION} END AS pos,
           doc_id
    FROM documents ORDER BY 1, 2 LIMIT 100)"""

EVENTS = """rows AS (SELECT l.*, d.text FROM labels l JOIN documents d USING (doc_id)),
events AS (
    SELECT doc_id * 4 AS seq, doc_id, text, quality::INT AS label FROM rows
    UNION ALL SELECT doc_id * 4 + 1, doc_id, text || ' (again)', 0 FROM rows WHERE toxic = 1
    UNION ALL SELECT doc_id * 4 + 2, doc_id, text, -1 FROM rows WHERE toxic = 1 AND quality = 0
    UNION ALL SELECT doc_id * 4 + 3, doc_id, text, 1 FROM rows WHERE toxic = 1 AND doc_id % 2 = 0)"""

LABELLED = """labelled AS (
    SELECT s.*, coalesce(l.quality, -1)::INT AS _label
    FROM {0} s LEFT JOIN labels l USING (doc_id))"""

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
STOPS = ", ".join(quoted(w) for w in ENGLISH)


def term_counts(source: str, key: str, name: str) -> str:
    return f"""{name} AS (
    SELECT {key}, term, count(*) AS tf
    FROM (SELECT {key}, unnest({TOKENS}) AS term FROM {source}) WHERE term NOT IN ({STOPS})
    GROUP BY {key}, term)"""


IDF = f"""{term_counts("documents", "doc_id", "tf")},
idf AS (
    SELECT term, count(*) AS df,
           ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
    FROM tf GROUP BY term)"""


def unit_vectors(counts: str, key: str, name: str) -> str:
    return f"""{name} AS (
    SELECT {key}, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY {key})) AS x
    FROM {counts} JOIN idf USING (term))"""


def similarity(references: str) -> str:
    """Every document's cosine to the mean vector of a table (ref_id, text)."""
    return f"""{IDF}, refs AS ({references}),
{term_counts("refs", "ref_id", "ref_tf")},
{unit_vectors("ref_tf", "ref_id", "ref_x")},
centre AS (SELECT term, sum(x) / (SELECT count(*) FROM refs) AS c FROM ref_x GROUP BY term),
{unit_vectors("tf", "doc_id", "doc_x")},
sims AS (
    SELECT doc_id, sum(x * c) / (SELECT sqrt(sum(c * c)) FROM centre) AS s
    FROM doc_x JOIN centre USING (term) GROUP BY doc_id)"""


SIMILARITY_RESULT = """SELECT doc_id, round(coalesce(s, 0.0::DOUBLE), 6) AS similarity
FROM documents LEFT JOIN sims USING (doc_id)"""

HIGHLIGHT_OPEN = "<span style=''background-color: {0}; color: black;''>"


def highlight(text: str, regex: str, color: str = "yellow") -> str:
    span = HIGHLIGHT_OPEN.format(color) + r"\1</span>"
    return f"regexp_replace({text}, {quoted(regex)}, '{span}', 'gi')"


KEYWORD_REGEX = "(" + "|".join("|".join(s.keywords) for s in SPECS) + ")"
COLOR_SPAN = (
    "'<span class=''' || CASE WHEN _pred > 0.5 THEN 'orange' ELSE 'blue' END"
    " || '--text darken-1''>' || {0} || '</span>'"
)
BADGE = (
    "CASE _label WHEN -1 THEN '' WHEN 1 THEN '<span class=''orange--text darken-1''>Labeled</span>'"
    " ELSE '<span class=''blue--text darken-1''>Labeled</span>' END"
)

# Newton's method on the penalised log loss, one step per table: intercept b and coefficients u, v
# of the features x and y. Each step solves a symmetric 3 x 3 system.
NEWTON_STEPS = 14


def newton(training: str) -> str:
    """Tables ending in ``model(b, u, v)``; training is a query (x, y, label)."""
    parts = [
        f"train AS MATERIALIZED ({training})",
        """sizes AS MATERIALIZED (
    SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS n1 FROM train)""",
        """weighted AS MATERIALIZED (
    SELECT x, y, label::DOUBLE AS t,
           CASE WHEN label = 1 THEN n / (2 * n1) ELSE n / (2 * (n - n1)) END AS w
    FROM train, sizes)""",
        """step0 AS MATERIALIZED (
    SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)""",
    ]
    for k in range(NEWTON_STEPS):
        parts.append(
            f"""sums{k} AS MATERIALIZED (
    SELECT b, u, v, sum(g) AS g0, sum(g * x) + u AS g1, sum(g * y) + v AS g2,
           sum(h) AS a, sum(h * x) AS d, sum(h * y) AS e,
           sum(h * x * x) + 1 AS f, sum(h * x * y) AS q, sum(h * y * y) + 1 AS r
    FROM (SELECT b, u, v, x, y, w * (p - t) AS g, w * p * (1 - p) AS h
          FROM (SELECT *, 1 / (1 + exp(-(b + u * x + v * y))) AS p FROM weighted, step{k}))
    GROUP BY b, u, v)"""
        )
        parts.append(
            f"""step{k + 1} AS MATERIALIZED (
    SELECT b - ((f * r - q * q) * g0 + (e * q - d * r) * g1 + (d * q - e * f) * g2) / det AS b,
           u - ((e * q - d * r) * g0 + (a * r - e * e) * g1 + (d * e - a * q) * g2) / det AS u,
           v - ((d * q - e * f) * g0 + (d * e - a * q) * g1 + (a * f - d * d) * g2) / det AS v
    FROM (SELECT *, a * (f * r - q * q) - d * (d * r - q * e) + e * (d * q - f * e) AS det
          FROM sums{k}))"""
        )
    parts.append(f"model AS MATERIALIZED (SELECT * FROM step{NEWTON_STEPS})")
    return ", ".join(parts)


FIT_X = f"{count_of(THE.keywords)} * {THE.weight**2}::DOUBLE"
FIT_Y = f"{count_of(ION.keywords)} * {ION.weight**2}::DOUBLE"
FITTED = newton(
    f"SELECT {FIT_X} AS x, {FIT_Y} AS y, quality AS label FROM documents JOIN labels USING (doc_id)"
)
FIT_PRED = "1 / (1 + exp(-(b + u * _the + v * _ion)))"
FIT_ROWS = f"SELECT *, {FIT_X} AS _the, {FIT_Y} AS _ion FROM {{0}}"


def covered(source: str, by_class: bool, digits: int, columns: Sequence[str] = COLUMNS) -> str:
    rows = []
    for c in columns:
        pos = f"count(*) FILTER ({c} > 0 AND _pred >= 0.5)" if by_class else "0::BIGINT"
        neg = f"count(*) FILTER ({c} > 0 AND _pred < 0.5)" if by_class else "0::BIGINT"
        rows.append(
            f"SELECT '{c[1:]}' AS feature, count(*) AS n, count(*) FILTER ({c} > 0) AS total,"
            f" {pos} AS pos, {neg} AS neg FROM {source}"
        )
    return f"""SELECT feature, total, pos, neg,
    round(coalesce(total / nullif(n, 0)::DOUBLE, 0), {digits}) AS total_pct,
    round(coalesce(pos / nullif(total, 0)::DOUBLE, 0), {digits}) AS pos_pct,
    round(coalesce(neg / nullif(total, 0)::DOUBLE, 0), {digits}) AS neg_pct
    FROM ({" UNION ALL ".join(rows)})"""


def histogram(source: str) -> str:
    """Bins from their edges alone: a score counts where it is above the start and up to the end."""
    return f"""
SELECT count(_pred)::BIGINT AS count, round(k * 0.02::DOUBLE, 2) AS bin,
       round(k * 0.02::DOUBLE + 0.02::DOUBLE, 2) AS bin_end
FROM (SELECT unnest(range(50)) AS k) LEFT JOIN {source}
    ON _pred > k * 0.02::DOUBLE AND _pred <= (k + 1) * 0.02::DOUBLE
GROUP BY k"""


def each(columns: Sequence[str], template: str) -> str:
    return ", ".join(template.format(c) for c in columns)


LATEST = "row_number() OVER (PARTITION BY {0} ORDER BY seq DESC) = 1"
PERCENT = (
    "CASE WHEN {0} * 100 > 0 AND {0} * 100 < 0.001 THEN '0.00'"
    " ELSE substr(({0} * 100.0::DOUBLE)::VARCHAR, 1, 4) END || '% (' || {1} || ')'"
)

SQL["load_corpus"] = "SELECT *, -1 AS _label FROM documents"
SQL["export_points"] = f"""WITH {SCORED}, {SAMPLE}, {LABELLED.format("scored")}
SELECT doc_id::VARCHAR AS id, CASE WHEN _pred > 0.5 THEN '#FB8C00' ELSE '#2196F3' END AS color,
       _label <> -1 AS labeled,
       {each(COLUMNS, "round(CASE WHEN total > 1 THEN {0} / total ELSE {0} END, 6) AS w{0}")}
FROM (SELECT *, {" + ".join(COLUMNS)} AS total FROM labelled JOIN sample USING (doc_id))
WHERE _pred BETWEEN 0.2 AND 0.95"""
SQL["keyword_count"] = f"""SELECT doc_id, {count_of(["the"])} AS one,
    {count_of(["ion", "tion", "ion"])} * 2 AS repeated, {count_of([" of "])} AS blank,
    {count_of(["ción", "é", "ñ"])} AS accented FROM documents"""
SQL["keyword_many"] = f"""WITH known AS (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS word FROM benchmark),
counted AS (
    SELECT doc_id, word, (length(lower(text)) - length(replace(lower(text), word, ''))) / length(word)::DOUBLE AS n
    FROM documents, known),
sums AS (
    SELECT doc_id, coalesce(sum(n) FILTER (word < 'm'), 0) AS _early, coalesce(sum(n) FILTER (word >= 'm'), 0) AS _late
    FROM counted GROUP BY doc_id)
SELECT doc_id, _early, {count_of(THE.keywords)} AS _the, _late FROM sums JOIN documents USING (doc_id)"""
SQL["featurize_wide"] = (
    f"WITH {FEATURED} SELECT doc_id, lang, -1 AS _label, {', '.join(COLUMNS)} FROM featured"
)
SQL["featurize_weighted"] = f"""SELECT doc_id, {count_of(ION.keywords)} * 2 AS alone,
    {count_of(ION.keywords)} * 4 AS listed FROM documents"""
SQL["rename_feature"] = (
    f"WITH {FEATURED} SELECT doc_id, _the, _ion AS _nation, _cion, _eau FROM featured"
)
SQL["drop_feature"] = (
    f"WITH {FEATURED} SELECT doc_id, lang, source, _the, _cion, _eau FROM featured"
)
SQL["custom_feature"] = f"""SELECT doc_id,
    round(length(text)::DOUBLE / (length(text) - length(replace(text, ' ', '')) + 1) * 0.5, 6)
        AS _letters, {count_of(THE.keywords)} AS _the FROM documents"""
SQL["custom_feature_columns"] = f"""SELECT doc_id,
    round({count_of(["chte", "erin", "tion"])} / greatest(n_chars, 1), 9) AS _share,
    {count_of(THE.keywords)} AS _the FROM documents"""
NEAR_COSINE = f"list_cosine_similarity(embedding::DOUBLE[], {list(NEAR)}::DOUBLE[])"
NEARNESS = f"CASE WHEN 2 * {NEAR_COSINE} - 1 < 0.1 THEN 0.0 ELSE 2 * {NEAR_COSINE} - 1 END"
SQL["embedding_feature"] = f"""SELECT doc_id, {count_of(THE.keywords)} AS _the,
    round(coalesce({NEARNESS} * 2, 0.0::DOUBLE), 6) AS _near
FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""
SUMS = f"sums AS (SELECT {each(COLUMNS, 'sum({0}) AS s{0}')} FROM featured)"
NORMED = each(COLUMNS, "round(CASE WHEN s{0} = 0 THEN 0 ELSE {0} / s{0} END, 9) AS {0}")
SQL["norm_l1"] = f"WITH {FEATURED}, {SUMS} SELECT doc_id, {NORMED} FROM featured, sums"
SQL["norm_l1_reference"] = f"""WITH {FEATURED}, {SUMS}
SELECT doc_id, {NORMED} FROM featured JOIN labels USING (doc_id), sums"""
SQL["row_cap_norm"] = f"""WITH {FEATURED}
SELECT doc_id, {each(COLUMNS, "round(CASE WHEN total > 1 THEN {0} / total ELSE {0} END, 6) AS {0}")}
FROM (SELECT *, {" + ".join(COLUMNS)} AS total FROM featured)"""
SQL["feature_value_counts"] = (
    f"WITH {FEATURED} SELECT _the, count(*) AS n FROM featured GROUP BY _the"
)

SQL["tab_sample"] = (
    f"WITH {SAMPLE} SELECT pos, doc_id, lang, text FROM sample JOIN documents USING (doc_id)"
)
SQL["tab_labeled"] = "SELECT doc_id, quality::INT AS _label, lang FROM documents JOIN labels USING (doc_id)"
SQL["tab_interesting"] = (
    f"WITH {SCORED} SELECT doc_id, round(_pred, 6) AS _pred FROM scored WHERE _pred > 0.5"
)
SQL["tab_selected"] = """WITH chosen AS (
    SELECT doc_id * 2 AS pos, doc_id FROM labels WHERE toxic = 1
    UNION ALL SELECT doc_id * 2 + 1, doc_id FROM labels WHERE quality = 0)
SELECT pos, doc_id, lang, source FROM chosen JOIN documents USING (doc_id)"""
SQL["search_regex"] = f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '{SEARCH}', 'i')"
SQL["search_rare"] = f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '{RARE_SEARCH}', 'i')"
SQL["search_without_literals"] = "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[aeiou]{4}', 'i')"
SQL["search_markup"] = (
    "SELECT page_id, url FROM pages WHERE regexp_matches(html, '<title>[^<]*ion', 'i')"
)
SQL["search_id"] = """SELECT doc_id, quality::INT AS _label, text, 0 AS searched
FROM documents JOIN labels USING (doc_id) WHERE doc_id = (SELECT min(doc_id) FROM labels)"""
SQL["tab_without_list"] = """SELECT unnest(['Sample', 'Selected', 'Interesting', 'Labeled']) AS tab, 0::BIGINT AS n
UNION ALL SELECT 'All', count(*) FROM documents"""
SQL["pred_range"] = (
    f"WITH {SCORED} SELECT doc_id, round(_pred, 6) AS _pred FROM scored"
    " WHERE _pred BETWEEN 0.3 AND 0.6"
)
SQL["pred_ge_half"] = (
    f"WITH {SCORED} SELECT doc_id, lang, round(_pred, 6) AS _pred FROM scored WHERE _pred >= 0.5"
)
CHAIN = f"""WITH {SCORED}, {LABELLED.format("scored")}, kept AS (
    SELECT * FROM labelled WHERE _label <> -1 AND regexp_matches(text, '{SEARCH}', 'i')
    AND _pred BETWEEN 0.1 AND 0.9)"""
SQL["filter_chain"] = f"{CHAIN} SELECT doc_id, _label, round(_pred, 6) AS _pred FROM kept"
SQL["filter_chain_count"] = f"{CHAIN} SELECT count(*) AS n FROM kept"
SQL["feature_active"] = f"""WITH {FEATURED}, {SAMPLE}
SELECT pos, doc_id, _ion FROM featured JOIN sample USING (doc_id) WHERE _ion > 0"""
SQL["co_activation"] = f"""WITH {FEATURED}
SELECT {each(COLUMNS, "{0} > 0 AS {0}")}, count(*) AS n FROM featured
GROUP BY {each(COLUMNS, "featured.{0} > 0")}"""
SQL["chain_filter"] = f"""WITH {FEATURED}, both_scores AS (
    SELECT doc_id, {logistic(FIXED_MODEL)} AS p0, {logistic(SECOND_MODEL)} AS p1 FROM featured)
SELECT doc_id, round(p0, 6) AS _pred_0, round(p1, 6) AS _pred_1, round(greatest(p0, p1), 6) AS best
FROM both_scores WHERE p0 > 0.5 AND p1 > 0.5"""

SQL["labels_applied"] = f"""WITH {EVENTS}, latest AS (
    SELECT * FROM events QUALIFY {LATEST.format("doc_id")})
SELECT doc_id, coalesce(label, -1)::INT AS _label, source
FROM documents LEFT JOIN latest USING (doc_id)"""
SQL["labels_bulk"] = """SELECT doc_id,
    coalesce(CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END, -1)::INT AS _label
FROM documents LEFT JOIN labels USING (doc_id)"""
SQL["label_all_filtered"] = f"""SELECT doc_id,
    CASE WHEN regexp_matches(text, '{SEARCH}', 'i') THEN 0 ELSE coalesce(quality, -1) END::INT
        AS _label
FROM documents LEFT JOIN labels USING (doc_id)"""
SQL["training_upsert"] = f"""WITH {EVENTS}
SELECT doc_id, text, label, seq FROM events WHERE label <> -1
QUALIFY {LATEST.format("doc_id, text")}"""
SQL["training_unlabel"] = f"""WITH {EVENTS},
removed AS (SELECT doc_id, max(seq) AS last FROM events WHERE label = -1 GROUP BY doc_id)
SELECT doc_id, text, label, seq FROM events LEFT JOIN removed USING (doc_id)
WHERE last IS NULL OR seq > last
QUALIFY {LATEST.format("doc_id, text")}"""
SQL["ledger_compacted"] = SQL["training_unlabel"]

SQL["coverage_total"] = f"WITH {FEATURED} {covered('featured', False, 6)}"
SQL["coverage_pos_neg"] = f"WITH {SCORED} {covered('scored', True, 6)}"
SQL["coverage_text"] = f"""WITH {SCORED}, c AS ({covered("scored", True, 15)})
SELECT feature, {PERCENT.format("total_pct", "total")} AS cov_text,
       {PERCENT.format("pos_pct", "pos")} AS pos_text,
       {PERCENT.format("neg_pct", "neg")} AS neg_text FROM c"""
SQL["hist_global"] = f"WITH {SCORED} {histogram('scored')}"
SQL["hist_local"] = (
    f"WITH {SCORED}, {SAMPLE}, local AS (SELECT * FROM scored JOIN sample USING (doc_id))"
    f" {histogram('local')}"
)
SQL["hist_unscored"] = """SELECT 0::BIGINT AS count, round(k * 0.02::DOUBLE, 2) AS bin,
    round(k * 0.02::DOUBLE + 0.02::DOUBLE, 2) AS bin_end FROM (SELECT unnest(range(50)) AS k)"""
SQL["pred_by_category"] = (
    f"WITH {SCORED} SELECT lang, count(*) AS n FROM scored WHERE _pred >= 0.5 GROUP BY lang"
)
SQL["confusion"] = f"""WITH {SCORED} SELECT
    count(*) FILTER (_pred >= 0.5 AND lang = 'en') AS tp,
    count(*) FILTER (_pred < 0.5 AND lang = 'en') AS fn,
    count(*) FILTER (_pred >= 0.5 AND lang <> 'en') AS fp,
    count(*) FILTER (_pred < 0.5 AND lang <> 'en') AS tn FROM scored"""
SQL["is_seeded"] = """SELECT count(*) AS labelled,
    count(*) >= 10 AND count(DISTINCT quality) = 2 AS seeded
FROM documents JOIN labels USING (doc_id)"""
SQL["seed_status"] = """SELECT labelled, interesting, uninteresting,
    greatest(10 - labelled, 0) AS remaining, interesting = 0 AS needs_interesting,
    uninteresting = 0 AS needs_uninteresting,
    labelled >= 10 AND interesting > 0 AND uninteresting > 0 AS seeded
FROM (SELECT count(*) AS labelled, count(*) FILTER (toxic = 1) AS interesting,
             count(*) FILTER (toxic = 0) AS uninteresting
      FROM labels)"""
SQL["class_weights"] = """SELECT quality AS label, count(*) AS n, round(
    (SELECT count(*) FROM labels)::DOUBLE
        / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY quality"""

SQL["page_sorted_id"] = (
    "SELECT doc_id, lang, text FROM documents ORDER BY doc_id DESC LIMIT 10 OFFSET 20"
)
SQL["page_sorted_col"] = """SELECT doc_id, n_chars, source FROM documents
ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 25"""
SQL["page_deep"] = (
    "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 20 OFFSET 160"
)
TWO_PASS = highlight(highlight("text", KEYWORD_REGEX), f"({SEARCH})", "white")
SQL["page_items"] = f"""WITH {SCORED}, {LABELLED.format("scored")}, {SAMPLE}, shown AS (
    SELECT * FROM labelled WHERE regexp_matches(text, '{SEARCH}', 'i') AND _pred BETWEEN 0.05 AND 1
    ORDER BY n_chars, doc_id LIMIT 10 OFFSET 10)
SELECT doc_id, {COLOR_SPAN.format(TWO_PASS)}
    AS text, {BADGE} AS labeled, doc_id IN (SELECT doc_id FROM sample) AS in_sample FROM shown"""
SQL["row_decoration"] = f"""WITH {SCORED}, {LABELLED.format("scored")}, {SAMPLE}
SELECT doc_id, {COLOR_SPAN.format(highlight("text", KEYWORD_REGEX))} AS text, {BADGE} AS labeled,
       doc_id IN (SELECT doc_id FROM sample) AS in_sample FROM labelled"""
SQL["random_sample"] = f"WITH {SAMPLE} SELECT * FROM sample"
SQL["sample_append"] = f"""WITH {SAMPLE}
SELECT pos, doc_id FROM sample
UNION ALL SELECT max(pos) + 1, {SAMPLE_EXTRA_ID} FROM sample
HAVING count(*) FILTER (doc_id = {SAMPLE_EXTRA_ID}) = 0"""
SQL["item_view"] = f"""WITH {SCORED}, {LABELLED.format("scored")}
SELECT doc_id, 'ID:' || doc_id AS title,
    {highlight(highlight("text", KEYWORD_REGEX), "(on)", "white")} AS text,
    CASE WHEN _label = -1 THEN 'Not labeled' ELSE 'Labeled' END AS label_text,
    CASE _label WHEN -1 THEN '' WHEN 1 THEN 'orange--text darken-1'
        ELSE 'blue--text darken-1' END AS label_class,
    'Prediction: ' || round(_pred, 6)::VARCHAR AS prediction_text,
    CASE WHEN round(_pred, 6) > 0.5 THEN 'orange--text darken-1'
        ELSE 'blue--text darken-1' END AS prediction_class
FROM labelled WHERE doc_id = {VIEW_ID}"""

SQL["highlight"] = f"SELECT doc_id, {highlight('text', KEYWORD_REGEX)} AS text FROM documents"
SQL["highlight_two_pass"] = f"""SELECT doc_id, '<span>' ||
    {highlight(highlight("text", KEYWORD_REGEX), "(span|ea)", "white")} || '</span>' AS text
FROM documents"""
SQL["tokenize_counts"] = f"""SELECT doc_id, len(t)::BIGINT AS n_tokens,
    len(list_distinct(t))::BIGINT AS n_distinct
FROM (SELECT doc_id, list_filter({TOKENS}, lambda w: w NOT IN ({STOPS})) AS t FROM documents)"""

SQL["tfidf_idf"] = f"WITH {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf"
SQL["tfidf_vectors"] = f"""WITH {IDF}, {unit_vectors("tf", "doc_id", "doc_x")}
SELECT doc_id, term, round(x, 6) AS x FROM doc_x"""
ONE_TEXT = f"SELECT 0 AS ref_id, {quoted(REFERENCE_TEXT)} AS text"
SQL["tfidf_sim_single"] = f"WITH {similarity(ONE_TEXT)} {SIMILARITY_RESULT}"
SQL["tfidf_sim_multi"] = (
    f"WITH {similarity('SELECT item_id AS ref_id, text FROM benchmark')} {SIMILARITY_RESULT}"
)
SQL["tfidf_sim_stored"] = SQL["tfidf_sim_multi"]
SQL["tfidf_feature"] = f"""WITH {similarity(ONE_TEXT)}
SELECT doc_id, {count_of(THE.keywords)} AS _the,
       round(coalesce(s, 0.0::DOUBLE) * 2, 6) AS _like, 0.0::DOUBLE AS _nothing
FROM documents LEFT JOIN sims USING (doc_id)"""
EXAMPLE = f"SELECT doc_id AS ref_id, text FROM documents WHERE doc_id = {EXAMPLE_ID}"
SQL["example_anchor"] = f"WITH {similarity(EXAMPLE)} {SIMILARITY_RESULT}"
SQL["reference_short"] = """WITH refs AS (
    SELECT doc_id AS ref_id, text FROM documents
    UNION ALL SELECT -1 - item_id, text FROM benchmark),
firsts AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)
SELECT ref_id, coalesce(first::VARCHAR, substr(text, 1, 25)) AS short
FROM refs LEFT JOIN firsts USING (text)"""
SQL["reference_by_id"] = """SELECT doc_id AS ref_id, text FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT -1 - item_id, text FROM benchmark"""

COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], r.embedding::DOUBLE[])"
SQL["embedding_sim"] = f"""SELECT doc_id, round(c, 6) AS cosine,
    round(CASE WHEN c * 2 - 1 < 0.25 THEN 0 ELSE c * 2 - 1 END, 6) AS feature
FROM (SELECT e.vec_id AS doc_id, {COSINE} AS c
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) r)"""
SQL["embed_missing"] = """SELECT doc_id, source FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""
LETTERS = "(length(text) - length(replace(text, '{0}', '')))::DOUBLE"
SQL["embed_batch"] = f"""SELECT doc_id, {each("aeiou", LETTERS + " AS n_{0}")} FROM documents"""
SQL["embed_incremental"] = f"""SELECT vec_id AS doc_id, unnest(range(len(embedding))) AS dim,
    round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings
UNION ALL SELECT doc_id, unnest(range(5)), unnest([{each("aeiou", LETTERS)}]) FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""
SQL["embed_changed"] = f"""WITH kept AS (
    SELECT DISTINCT d.text FROM documents d JOIN labels USING (doc_id) WHERE toxic = 0)
SELECT doc_id, {each("aeiou", LETTERS + " + CASE WHEN text IN (SELECT text FROM kept) THEN 1 ELSE 0 END AS n_{0}")}
FROM documents"""
SQL["mean_pool"] = """SELECT label, dim, round(avg(value), 6) AS value
FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS value
      FROM embeddings) GROUP BY label, dim"""

SQL["score_fixed_coef"] = f"WITH {SCORED} SELECT doc_id, round(_pred, 6) AS _pred FROM scored"
SQL["fit_logreg"] = f"""WITH {FITTED}
SELECT '(intercept)' AS feature, round(b, 5) AS coefficient FROM model
UNION ALL SELECT '_the', round(u, 5) FROM model
UNION ALL SELECT '_ion', round(v, 5) FROM model"""
SQL["coefficients"] = f"""WITH {FITTED}
SELECT '_the' AS feature, round(u, 5) AS coefficient FROM model
UNION ALL SELECT '_ion', round(v, 5) FROM model"""
SQL["score_corpus"] = f"""WITH {FITTED}, f AS ({FIT_ROWS.format("documents")})
SELECT doc_id, coalesce(quality, -1)::INT AS _label, round({FIT_PRED}, 4) AS _pred
FROM f LEFT JOIN labels USING (doc_id), model"""
SQL["labeled_after_triage"] = "SELECT doc_id, quality::INT AS _label FROM documents JOIN labels USING (doc_id)"
KEPT = f"""{EVENTS}, kept AS (
    SELECT doc_id, text, label, seq FROM events
    LEFT JOIN (SELECT doc_id, max(seq) AS last FROM events WHERE label = -1 GROUP BY doc_id) USING (doc_id)
    WHERE last IS NULL OR seq > last QUALIFY {LATEST.format("doc_id, text")})"""
SQL["score_second_corpus"] = f"""WITH {KEPT},
{newton(f"SELECT {FIT_X} AS x, {FIT_Y} AS y, label FROM kept")},
f AS ({FIT_ROWS.format("conversations")})
SELECT conv_id, turn, _the, _ion, round({FIT_PRED}, 4) AS _pred FROM f, model"""


def like_of(source: str, key: str) -> str:
    """Rows (key, s): cosine to the reference text of another table's texts, under the documents' idf."""
    return f"""{similarity(ONE_TEXT)}, {term_counts(source, key, "own_tf")},
{unit_vectors("own_tf", key, "own_x")},
own AS (SELECT {key}, sum(x * c) / (SELECT sqrt(sum(c * c)) FROM centre) AS s
        FROM own_x JOIN centre USING (term) GROUP BY {key})"""


SQL["score_second_corpus_tfidf"] = f"""WITH {like_of("conversations", "conv_id, turn")},
f AS (SELECT conv_id, turn, {count_of(THE.keywords)} AS _the, coalesce(s, 0.0::DOUBLE) * 2 AS _like
      FROM conversations LEFT JOIN own USING (conv_id, turn))
SELECT conv_id, turn, _the, round(_like, 6) AS _like,
       round(1 / (1 + exp(-(-0.5::DOUBLE + 0.02::DOUBLE * _the + 1.5::DOUBLE * _like))), 6) AS _pred FROM f"""
SQL["session_roundtrip"] = f"""WITH {KEPT}, {like_of("kept", "seq")},
f AS (SELECT seq AS doc_id, {count_of(THE.keywords, "text")} AS _the, coalesce(s, 0.0::DOUBLE) * 2 AS _like,
             coalesce({NEARNESS}, 0.0::DOUBLE) AS _near
      FROM kept LEFT JOIN own USING (seq) LEFT JOIN embeddings ON vec_id * 4 = seq)
SELECT doc_id, _the, round(_like, 6) AS _like, round(_near, 6) AS _near,
       round({logistic(SESSION_MODEL)}, 6) AS _pred FROM f"""
SQL["untrain_drops_pred"] = f"""WITH {FEATURED}
SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END::INT AS _label, {", ".join(COLUMNS)}
FROM featured LEFT JOIN labels USING (doc_id)"""
SQL["retrain_and_score"] = f"""WITH {FITTED}, f AS ({FIT_ROWS.format("documents")}),
s AS (SELECT *, {FIT_PRED} AS _pred FROM f, model) {covered("s", True, 4, ["_the", "_ion"])}"""

SQL["stream_score"] = (
    f"WITH {SCORED} SELECT doc_id, {', '.join(COLUMNS)}, round(_pred, 6) AS _pred FROM scored"
)
SQL["stream_labels"] = """SELECT doc_id, 'row ' || doc_id AS text, quality::INT AS label,
    doc_id * 2 + 1 AS seq FROM labels WHERE toxic = 0"""
SQL["stream_labels_compacted"] = SQL["stream_labels"]
