"""The registered queries of this subpackage: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, chat_format, decontaminate, hard_negatives, ngram_join, quality_rules, recurrent_lm, secret_crf, sentence_spans, spelling_variants, suffix_dedup, token_counts, warc_revisit
from threadloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN).drop("text")


@query("op3_token_counts")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


CONTAMINATION_SQL = """
WITH fold AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
pats AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p
  FROM (SELECT item_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i
        FROM (SELECT *, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT m FROM pats),
wins AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM fold, lens WHERE len(w) >= m)),
found AS (SELECT w.doc_id, w.m, w.i, p.item_id FROM wins w JOIN pats p ON p.m = w.m AND p.p = w.p),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM fold f LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op9_wu_manber", CONTAMINATION_SQL)
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        "contaminated",
    )


def quality_sql() -> str:
    """The rules once more, compiled into DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    checks = []
    for r in quality_rules.RULES:
        checks += [f"1000 * {r.numerator} >= {r.low} * {r.denominator}"] * (r.low is not None)
        checks += [f"1000 * {r.numerator} <= {r.high} * {r.denominator}"] * (r.high is not None)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM d) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaims,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(checks)} AS kept FROM b
"""


@query("op10_quality_rules", quality_sql())
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


PREFERENCES_SQL = """
WITH last AS (SELECT conv_id, max({'turn': turn, 'text': text}) FILTER (role = 'assistant') AS reply FROM conversations GROUP BY conv_id),
chosen AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
rejected AS (
  SELECT c.* FROM chosen c JOIN last l ON l.conv_id = c.pair_id WHERE l.reply IS NULL OR c.turn < l.reply.turn
  UNION ALL SELECT a.conv_id, a.reply.turn, 'assistant', coalesce(b.reply.text, '') FROM last a JOIN last b ON b.conv_id = a.conv_id + 1
  WHERE a.reply IS NOT NULL AND b.reply IS NOT NULL),
turns AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt
  FROM chosen c FULL JOIN rejected r ON r.pair_id = c.pair_id AND r.turn = c.turn),
cut AS (SELECT *, coalesce(turn < min(turn) FILTER (cr IS DISTINCT FROM rr OR ct IS DISTINCT FROM rt) OVER (PARTITION BY pair_id), true) AS common FROM turns),
rows AS (SELECT pair_id, turn, 'prompt' AS side, cr AS role, ct AS text FROM cut WHERE common
  UNION ALL SELECT pair_id, turn, 'chosen', cr, ct FROM cut WHERE NOT common AND cr IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', rr, rt FROM cut WHERE NOT common AND rr IS NOT NULL),
said AS (SELECT *, '<|' || role || '|>' || chr(10) AS h, replace(text, '<|', '<\\|') || '<|end|>' || chr(10) AS t FROM rows)
SELECT pair_id, side, CAST(turn // 1000 AS BIGINT) AS part, count(*) AS n_turns, sha256(string_agg(h || t, '' ORDER BY turn)) AS body_sha256,
  string_agg(length(h) || '-0,' || length(t) || CASE WHEN side <> 'prompt' AND role = 'assistant' THEN '-1' ELSE '-0' END, ',' ORDER BY turn) AS mask
FROM said GROUP BY ALL
"""


@query("op5_preference_format", PREFERENCES_SQL)
def op5(spark, sf_dir):
    pairs = chat_format.replies_of_the_next(table(spark, sf_dir, "conversations"))
    mask = F.transform("mask", lambda s: F.concat_ws("-", s["length"], s["loss"].cast("int")))
    return chat_format.format_preferences(*pairs).select(
        "pair_id", "side", "part", "n_turns", F.sha2("body", 256).alias("body_sha256"), F.array_join(mask, ",").alias("mask")
    )


REVISIT_SQL = """
WITH u AS (SELECT page_id, html, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS p FROM pages),
v AS (SELECT *, regexp_extract(p, '^([A-Za-z][A-Za-z0-9+.-]*://)?([^?]*)', 2) AS place, regexp_extract(p, '\\?(.*)$', 1) AS asked FROM u),
k AS (SELECT page_id, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^(www[0-9]*|m)\\.', '')
  || regexp_replace(regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/index\\.html?$', '/'), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(asked, '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q),
     '^(utm_[a-z]+|fbclid|gclid|sessionid|jsessionid|phpsessid)(=|$)'))), '&'), ''), '') AS url_key FROM v),
a AS (SELECT page_id, url_key, digest, bytes, page_id * 60 AS ts FROM k),
r AS (SELECT page_id, url_key, digest AS own, (page_id + 5000) * 60 AS ts FROM k),
j AS (SELECT r.*, a.page_id AS ap, a.digest, a.bytes FROM r ASOF LEFT JOIN a ON r.url_key = a.url_key AND r.ts >= a.ts),
f AS (SELECT *, CASE WHEN ap IS NULL THEN 'no_response' WHEN own[1:16] = digest[1:16] THEN 'resolved' ELSE 'mismatch' END AS verdict,
  'date: ' || strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: W/"' || own[1:16] || '"' || chr(10)
  || 'expires: ' || strftime(to_timestamp(ts + 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS sent FROM j)
SELECT page_id * 2 + 1 AS revisit_id, url_key, ts, CASE WHEN verdict = 'resolved' THEN ap * 2 END AS response_id,
  CASE WHEN verdict = 'resolved' THEN digest END AS digest, verdict,
  CASE WHEN verdict = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || sent
  ELSE 'content-type: application/http' || chr(10) || sent END AS headers FROM f
"""


@query("op6_revisit_resolution", REVISIT_SQL)
def op6(spark, sf_dir):
    found = warc_revisit.resolve(warc_revisit.crawl_of(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc_revisit.header_lines(F.col("headers")))


@query("op8_sentence_spans")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.deduplicate(docs).select(
        "doc_id",
        "n_units",
        "n_removed",
        F.octet_length("text").cast("bigint").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op4_ngram_join")
def op4(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query("op2_recurrent_lm")
def op2(spark, sf_dir):
    return recurrent_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op12_secret_crf")
def op12(spark, sf_dir):
    found = secret_crf.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        *(count(kind) for kind in secret_crf.KINDS[:3]),
        F.sha2(secret_crf.listed(base), 256).alias("base_sha256"),
        secret_crf.listed(F.col("spans")).alias("spans"),
    )


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    found = spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


HARD_NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""


@query("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), "vec_id % 50 = 0")
