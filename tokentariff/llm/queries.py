"""One query per operator, over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentariff.llm import (decontamination, hard_negatives, html_templates, line_runs, mixing,
                             ngram_join, pivot_index, quality_rules, source_divergence,
                             token_counts, toxicity, url_templates, warc)
from tokentariff.llm.text import work_folder

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "depleted")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, folder, "documents"),
                                          table(spark, folder, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return decontamination.judged(hits).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = work_folder(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), archive)
    return warc.read_archive(spark, archive, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit(documents, table(spark, folder, "labels"))
    return toxicity.score_texts(documents.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_templates.extract_text(table(spark, folder, "pages"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, folder, "documents"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, folder, "pages")).select(
        "page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_runs.drop_repeated_lines(table(spark, folder, "documents")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), TOKENIZER)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), moved)


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.source_divergence(table(spark, folder, "documents"))


def op13_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_index.exact_top_k(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_decontamination, op3_warc, op4_toxicity, op5_html, op6_ngram_join,
        op7_url_filter, op8_mixing, op9_line_dedup, op10_token_counts,
        op11_hard_negatives, op12_source_divergence, op13_exact_top_k)}


# --------------------------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------------------------

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIMMED = r"trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_RULES = f"""
WITH docs AS (SELECT doc_id, source, COALESCE(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM docs),
places AS (SELECT doc_id, w, UNNEST(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, COUNT(*) OVER (
              PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM places),
repeated AS (SELECT doc_id, COUNT(DISTINCT p) AS n_repeat_words
             FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1)
             GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, UNNEST(string_split(text, chr(10))) AS line FROM docs),
full_lines AS (SELECT * FROM lines WHERE {TRIMMED.format('line')} <> ''),
dups AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines
         FROM full_lines GROUP BY doc_id),
normal AS (SELECT doc_id, source, text, lower({TRIMMED.format('line')}) AS line FROM full_lines),
often AS (SELECT source, line FROM normal GROUP BY source, line
          HAVING COUNT(DISTINCT text) > {quality_rules.LIMIT}),
chars AS (SELECT doc_id, SUM(length(line)) AS n,
                 SUM(CASE WHEN (source, line) IN (SELECT (source, line) FROM often)
                          THEN length(line) ELSE 0 END) AS gone
          FROM normal GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w.w) AS n_words,
         length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         COALESCE(u.n_dup_lines, 0) AS n_dup_lines,
         COALESCE(r.n_repeat_words, 0) AS n_repeat_words,
         COALESCE(100.0 * (c.n - c.gone) / c.n, 100.0) < {quality_rules.LEAST_LEFT} AS depleted
  FROM docs d JOIN worded w USING (doc_id) LEFT JOIN dups u USING (doc_id)
  LEFT JOIN repeated r USING (doc_id) LEFT JOIN chars c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT depleted AS kept
FROM counted"""

ALPHANUMERIC = (r"list_filter(regexp_split_to_array(" + LOWERED + r", "
                r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, COALESCE({ALPHANUMERIC.format("COALESCE(text, '')")}, []) AS w
              FROM documents),
items AS (SELECT item_id, {ALPHANUMERIC.format('text')} AS w FROM benchmark
          WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(13, len(w)) AS n, UNNEST(range(1, greatest(len(w) - 12, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, UNNEST(range(1, len(w) - n + 2)) AS i FROM docs, sizes
        WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, s)),
hit AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, UNNEST(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(*) AS n_items,
                 string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

WARC = """
WITH digests AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes,
                        sha256(COALESCE(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, MIN(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM digests)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND smallest <> page_id THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN payload_bytes >= 100 AND smallest <> page_id THEN smallest END AS refers_to
FROM firsts"""

NGRAM_JOIN = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {WORDS.format(LOWERED.format("COALESCE(text, '')"))} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS both_have
          FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * both_have >= 75 * (x.n + y.n - both_have)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, MIN(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""


def _rule_sql() -> str:
    cases = []
    for verdict, rule in sorted(url_templates.RULES, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) "
                     f"AND starts_with(path, '{slash}{rest}') "
                     f"THEN {{'verdict': '{verdict}', 'rule': '{rule}'}}")
    return "CASE " + " ".join(cases) + " END"


URL_FILTER = rf"""
WITH parsed AS (
  SELECT page_id, {LOWERED.format("COALESCE(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT *, {_rule_sql()} AS r,
         array_to_string(list_transform(string_split(path, '/'), lambda s:
           CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > 40 THEN '*' ELSE s END), '/')
           AS template
  FROM parsed),
counts AS (SELECT host, template, COUNT(r.verdict) AS labelled,
                  COUNT(*) FILTER (r.verdict = 'block') AS blocked
           FROM ruled GROUP BY host, template),
nodes AS (SELECT host, template, i, parts[i] AS segment, array_to_string(parts[:i - 1], '/') AS parent
          FROM (SELECT host, template, string_split(template, '/') AS parts,
                       UNNEST(range(1, len(string_split(template, '/')) + 1)) AS i FROM counts)),
wide AS (SELECT host, parent, i FROM nodes GROUP BY host, parent, i
         HAVING COUNT(DISTINCT segment) > {url_templates.MAX_CHILDREN}),
general AS (
  SELECT host, template, string_agg(CASE WHEN wide.i IS NULL THEN segment ELSE '*' END, '/'
                                    ORDER BY nodes.i) AS general
  FROM nodes LEFT JOIN wide USING (host, parent, i) GROUP BY host, template),
branches AS (
  SELECT host, general, SUM(labelled) AS labelled, SUM(blocked) AS blocked,
         regexp_replace(general, '[^/*]+((/\*|/)*)$', '*\1') AS node
  FROM counts JOIN general USING (host, template) GROUP BY host, general),
pooled AS (
  SELECT *, SUM(labelled) FILTER (labelled >= {url_templates.LEAST}) OVER (PARTITION BY host, node) AS l,
         SUM(blocked) FILTER (labelled >= {url_templates.LEAST}) OVER (PARTITION BY host, node) AS b
  FROM branches),
tested AS (
  SELECT *, CASE WHEN labelled >= {url_templates.LEAST}
                 THEN abs(1e0 * blocked / labelled - 1e0 * b / l) <= {url_templates.MAX_Z}
                      * sqrt((1e0 * b / l) * (1 - 1e0 * b / l) * (1e0 / labelled + 1e0 / l))
                 ELSE FALSE END AS merged FROM pooled),
summed AS (
  SELECT host, general,
         CASE WHEN merged THEN SUM(labelled) OVER (PARTITION BY host, node, merged)
              ELSE labelled END AS labelled,
         CASE WHEN merged THEN SUM(blocked) OVER (PARTITION BY host, node, merged)
              ELSE blocked END AS blocked FROM tested)
SELECT page_id, host, path, r.rule AS rule,
       COALESCE(r.verdict, CASE WHEN (blocked + {url_templates.STRENGTH} / 2)
                                     / (labelled + {url_templates.STRENGTH})
                                     >= {url_templates.REJECT} THEN 'block' ELSE 'allow' END)
         AS verdict
FROM ruled JOIN general USING (host, template) JOIN summed USING (host, general)"""

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS.format("COALESCE(text, '')")}) AS size,
         CASE WHEN COALESCE(length(text), 0) = 0 THEN 1e0
              ELSE greatest(0.1e0, 1e0 - 5e0 * (length(text)
                   - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) / length(text)) END AS weight,
         ('0x' || substr(md5('{mixing.SEED}' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13))
           ::BIGINT AS digits
  FROM documents),
drawn AS (SELECT *, -ln((digits + 0.5e0) / 4503599627370496e0) / weight AS key FROM sized),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         [3e0, 1e0, 2e0][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 2 * source_size AS cap,
         (SUM(source_size) OVER () * 150 / 100e0 - COALESCE(SUM(2 * source_size) OVER before, 0))
           / SUM(weight) OVER rest AS level
  FROM sources
  WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY 2 * source_size / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
    ELSE weight * MAX(level) FILTER (cap > level * weight) OVER () END AS target
  FROM capped),
summed AS (
  SELECT d.*, source_size, target,
         COALESCE(CAST(floor(target / NULLIF(source_size, 0)) AS BIGINT), 0) AS epochs,
         SUM(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
                         ROWS UNBOUNDED PRECEDING) AS upto
  FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN epochs < 2 AND upto - size / 2e0
                                       <= target - epochs * source_size THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM summed"""

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(COALESCE(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, {LOWERED.format(TRIMMED.format('line'))} AS key FROM lines),
repeated AS (SELECT key, MAX(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_runs.SHORTEST}
             GROUP BY key HAVING COUNT(DISTINCT doc_id) >= {line_runs.LEAST}),
marked AS (SELECT doc_id, i, line, COALESCE(keeper <> doc_id, FALSE) AS gone
           FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


SOURCE_DIVERGENCE = f"""
WITH docs AS (SELECT ROW_NUMBER() OVER () AS doc, COALESCE(lang, '') AS lang,
                     COALESCE(source, '') AS source, COALESCE(text, '') AS text FROM documents),
words AS (SELECT doc, lang, source, UNNEST(list_filter(regexp_split_to_array(
            {LOWERED.format('text')}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
          FROM docs),
kept AS (SELECT lang, term, COUNT(*) AS n FROM words GROUP BY lang, term
         HAVING COUNT(DISTINCT doc) >= {source_divergence.LEAST_DOCS}),
langs AS (SELECT lang, COUNT(*) AS v, SUM(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, COUNT(*) AS n FROM words JOIN kept USING (lang, term)
           GROUP BY lang, source, term),
sizes AS (SELECT lang, source, SUM(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 1)) // (COALESCE(s.total, 0) + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
         GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
          FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {source_divergence.TOP_TERMS}"""


WHOLE_VECTORS = """
WITH vectors AS (
  SELECT ROW_NUMBER() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

HARD_NEGATIVES = WHOLE_VECTORS + """,
labelled AS (
  SELECT r, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM vectors WHERE label IS NOT NULL),
scored AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id,
         a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM labelled a JOIN labelled b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor ORDER BY score DESC, other_id, other) <= 5),
windows AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score, ROW_NUMBER() OVER (
           PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id, n.other) AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM windows WHERE rank <= 5"""

EXACT_TOP_K = WHOLE_VECTORS + """,
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) AS rank FROM scored)
WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY_RULES,
        "op2_decontamination": DECONTAMINATION,
        "op3_warc": WARC,
        "op6_ngram_join": NGRAM_JOIN,
        "op7_url_filter": URL_FILTER,
        "op8_mixing": MIXING,
        "op9_line_dedup": LINE_DEDUP,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_source_divergence": SOURCE_DIVERGENCE,
        "op13_exact_top_k": EXACT_TOP_K,
    }
