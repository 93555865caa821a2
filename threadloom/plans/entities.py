"""Registered entity and graph queries over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import dims, fixed
from threadloom.operators import entities as E
from threadloom.plans.registry import query
from threadloom.plans.reports import values
from threadloom.session import saved
from threadloom.sources.testviews import load, table

# Technical phrases woven into the texts by conversation, so that every extractor has work on the whole table.
PLANTED = [
    (0, " See https://docs.example.com/a/b?c=1, then POST /api/v1/users/{id} now."),
    (1, " Edit ./src/app/main.py and /etc/nginx/nginx.conf today."),
    (2, " from django.db import models; require('left-pad') import numpy"),
    (3, " Set API_TOKEN and DATABASE_URL but not HELLO_WORLD."),
    (4, " We use Python with Spring Boot, next.js and gpt-4o; Docker uses Kubernetes."),
    (5, " React depends on JavaScript; java and React.js are part of Docker"),
]
PLANT_SQL = (
    "full_text || CASE conv_id % 7 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in PLANTED) + " ELSE '' END"
)


def re2(pattern: str) -> str:
    return pattern.replace("(?U)", "").replace("'", "''")


TERMS = [line.split(" = ") for line in fixed.TECHNOLOGY_TERMS.strip().splitlines()]
WEIGHTS = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TYPE_WEIGHTS.items()) + " ELSE 0.3 END"

VIEWS = {
    "v_tech": f"SELECT conv_id, turn, role, {PLANT_SQL} AS full_text FROM v_messages",
    "v_terms": (
        f"SELECT * FROM (VALUES {values([(t, c, 'tech', i) for i, (t, c) in enumerate(TERMS)])}) AS t(term, canonical, type,"
        " place) UNION ALL SELECT term, canonical, type, 1000 + row_number() OVER (ORDER BY term) FROM v_gazetteer"
    ),
    # The one-word dictionary matches are the mentions that the graph oracles start from.
    "v_mentions": (
        "SELECT m.conv_id, m.turn, 'tech:' || lower(t.canonical) AS key, t.canonical AS name, t.type, t.place FROM (SELECT"
        " conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(full_text), '[a-z0-9_\\-]+'))) AS term FROM v_tech)"
        " m JOIN v_terms t ON t.term = m.term"
    ),
    "v_raw": (
        "SELECT conv_id, key, any_value(name) AS name, any_value(type) AS type, count(*) AS mention_count, min(turn) AS"
        " first_turn, max(turn) AS last_turn, arg_min(place, (turn, place)) AS place FROM v_mentions GROUP BY ALL"
    ),
    "v_resolved": (
        "SELECT r.*, lower(name) AS low, row_number() OVER (PARTITION BY conv_id ORDER BY mention_count DESC, first_turn,"
        " place) AS rank FROM v_raw r"
    ),
    "v_pairs": (
        "SELECT a.conv_id, a.low AS src, b.low AS dst, count(*) AS evidence, round(least(CAST(1.0 AS DOUBLE), 0.5 + 0.1 * (count(*) - 1)),"
        " 4) AS confidence FROM (SELECT DISTINCT m.conv_id, m.turn, r.low, r.rank FROM v_mentions m JOIN v_resolved r ON"
        " r.conv_id = m.conv_id AND r.key = m.key) a JOIN (SELECT DISTINCT m.conv_id, m.turn, r.low, r.rank FROM v_mentions"
        " m JOIN v_resolved r ON r.conv_id = m.conv_id AND r.key = m.key) b ON a.conv_id = b.conv_id AND a.turn = b.turn AND"
        " a.rank < b.rank GROUP BY ALL"
    ),
    "v_degree": (
        "SELECT conv_id, low, count(*) AS degree FROM (SELECT conv_id, src AS low FROM v_pairs UNION ALL SELECT conv_id, dst"
        " FROM v_pairs) GROUP BY ALL"
    ),
    "v_scored_entities": (
        "SELECT r.*, coalesce(d.degree, 0) AS degree, last_turn / n AS recency, round(least(1.0, greatest(0.0, 0.3 *"
        " (last_turn / n) + 0.3 * mention_count / max(mention_count) OVER (PARTITION BY r.conv_id) + 0.2 *"
        " coalesce(d.degree, 0) / coalesce(max(d.degree) OVER (PARTITION BY r.conv_id), 1) + 0.2 * " + WEIGHTS + ")), 4) AS"
        " importance FROM v_resolved r JOIN (SELECT conv_id, count(*) AS n FROM v_messages GROUP BY 1) m ON m.conv_id ="
        " r.conv_id LEFT JOIN v_degree d ON d.conv_id = r.conv_id AND d.low = r.low"
    ),
}


def messages(spark, sf_dir):
    m = load(spark, sf_dir, "v_messages")
    extra = None
    for k, v in PLANTED:
        hit = F.col("conv_id") % 7 == k
        extra = F.when(hit, v) if extra is None else extra.when(hit, v)
    return m.withColumn("full_text", F.concat("full_text", extra.otherwise("")))


def dictionary(spark, sf_dir):
    """The fixed technology terms and the corpus' own frequent words."""
    from pyspark.sql import Window

    own = load(spark, sf_dir, "v_gazetteer")
    place = F.row_number().over(Window.orderBy("term")) + 1000  # at most 200 rows
    return saved(dims.technology_terms(spark).unionByName(own.withColumn("place", place)), "dictionary")


def one_word_terms(spark, sf_dir):
    """The terms the graph oracles use: those without inner separators."""
    return dictionary(spark, sf_dir).where(F.col("term").rlike(rf"^{E.WORD}$"))


def graph_inputs(spark, sf_dir):
    """Mentions, raw entities, resolution and relationships of the one-word terms, written once and shared."""
    m = messages(spark, sf_dir)
    mentions = saved(E.term_mentions(m, one_word_terms(spark, sf_dir)), "mentions")
    raw = saved(E.raw_entities(mentions), "raw")
    resolved = saved(E.resolve_exact(raw), "resolved")
    return m, mentions, raw, resolved


def scored(spark, sf_dir):
    m, mentions, raw, resolved = graph_inputs(spark, sf_dir)
    relationships = saved(E.cooccurrence(mentions, resolved), "relationships")
    return E.with_importance(E.entities_of(raw, resolved), relationships, m), relationships, raw


def pattern_rows(spark, sf_dir, source):
    rows = E.pattern_mentions(messages(spark, sf_dir)).where(F.col("source") == E.SOURCES[source])
    return rows.groupBy("conv_id", "turn", "key", "name").agg(F.count("*").alias("mentions"))


@query("file_path_mentions", "E1")
def file_path_mentions(spark, sf_dir):
    return pattern_rows(spark, sf_dir, "file_path")


@query(
    "url_mentions", "E2",
    f"""
SELECT conv_id, turn, lower(u) AS key, u AS name, count(*) AS mentions FROM (SELECT conv_id, turn,
    unnest(regexp_extract_all(full_text, '{re2(fixed.URL_PATTERN)}')) AS u FROM v_tech) GROUP BY ALL
""",
    VIEWS,
)
def url_mentions(spark, sf_dir):
    return pattern_rows(spark, sf_dir, "url")


@query(
    "page_url_mentions", "E2",
    f"""
SELECT page_id, u AS name, count(*) AS mentions FROM (SELECT page_id, unnest(regexp_extract_all(url || ' ' || html,
    '{re2(fixed.URL_PATTERN)}')) AS u FROM pages) GROUP BY ALL
""",
)
def page_url_mentions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("conv_id"), F.lit(0).alias("turn"), F.concat_ws(" ", "url", "html").alias("full_text")
    )
    rows = E.pattern_mentions(pages).where(F.col("source") == E.SOURCES["url"])
    return rows.groupBy(F.col("conv_id").alias("page_id"), "name").agg(F.count("*").alias("mentions"))


@query("endpoint_mentions", "E3")
def endpoint_mentions(spark, sf_dir):
    return pattern_rows(spark, sf_dir, "endpoint")


@query(
    "import_mentions", "E4",
    """
SELECT conv_id, turn, 'import:' || lower(x) AS key, x AS name, count(*) AS mentions FROM (SELECT conv_id, turn,
    unnest(list_transform(regexp_extract_all(full_text, '{p}', 0), lambda t: coalesce(nullif(regexp_extract(t, '{p}', 1),
    ''), nullif(regexp_extract(t, '{p}', 2), ''), regexp_extract(t, '{p}', 3)))) AS x FROM v_tech) WHERE length(x) >= 2
GROUP BY ALL
""".replace("{p}", re2(fixed.IMPORT_PATTERN)),
    VIEWS,
)
def import_mentions(spark, sf_dir):
    return pattern_rows(spark, sf_dir, "import")


@query(
    "env_var_mentions", "E5",
    f"""
SELECT conv_id, turn, lower(w) AS key, w AS name, count(*) AS mentions FROM (SELECT conv_id, turn,
    unnest(regexp_extract_all(full_text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM v_tech) WHERE regexp_full_match(w,
    '[A-Z][A-Z0-9_]{{2,}}') AND ({" OR ".join(f"starts_with(w, '{p}')" for p in fixed.ENV_VAR_PREFIXES)}) GROUP BY ALL
""",
    VIEWS,
)
def env_var_mentions(spark, sf_dir):
    return pattern_rows(spark, sf_dir, "env_var")


@query(
    "code_symbol_mentions", "E6",
    """
SELECT conv_id || ':' || turn AS conv_id, CAST(0 AS INT) AS turn, 'symbol:f' || turn AS key, 'f' || turn AS name FROM
    v_messages WHERE role <> 'system' AND turn >= 0
""",
)
def code_symbol_mentions(spark, sf_dir):
    from threadloom.plans.ingest import fenced
    from threadloom.sources import dialects as D

    return E.symbol_mentions(D.block_rows(fenced(spark, sf_dir)[1])).select("conv_id", "turn", "key", "name")


@query(
    "term_mentions", "E7", "SELECT conv_id, turn, key, name, place AS ix FROM v_mentions", VIEWS,
)
def term_mentions(spark, sf_dir):
    return E.term_mentions(messages(spark, sf_dir), one_word_terms(spark, sf_dir)).select(
        "conv_id", "turn", "key", "name", "ix"
    )


@query(
    "phrase_mentions", "E7",
    """
SELECT conv_id, turn, 'tech:' || lower(canonical) AS key, count(*) AS terms FROM v_tech JOIN v_terms ON contains(lower(
    full_text), term) WHERE (contains(term, ' ') OR contains(term, '.')) AND regexp_matches(' ' || lower(full_text) || ' ',
    '[^a-z0-9_\\-]' || replace(term, '.', '\\.') || '[^a-z0-9_\\-]') GROUP BY ALL
""",
    VIEWS,
)
def phrase_mentions(spark, sf_dir):
    terms = dictionary(spark, sf_dir).where(~F.col("term").rlike(rf"^{E.WORD}$"))
    found = E.term_mentions(messages(spark, sf_dir), terms)
    return found.groupBy("conv_id", "turn", "key").agg(F.count("*").alias("terms"))


@query(
    "mention_totals", "E8",
    "SELECT conv_id, key, name, type, mention_count, first_turn, last_turn FROM v_raw", VIEWS,
)
def mention_totals(spark, sf_dir):
    _, _, raw, _ = graph_inputs(spark, sf_dir)
    return raw.drop("at")


@query(
    "entity_exact_merge", "E9",
    """
SELECT conv_id, low, arg_min(name, (-n, first_place)) AS name, CAST(sum(n) AS BIGINT) AS mention_count, min(lo) AS first_turn,
    max(hi) AS last_turn FROM (SELECT conv_id, lower(w) AS low, w AS name, count(*) AS n, min(turn) AS lo, max(turn) AS hi,
    min(turn * 100000 + ix) AS first_place FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS ix
    FROM (SELECT conv_id, turn, regexp_extract_all(full_text, '[A-Za-z]+') AS ws FROM v_messages)) GROUP BY ALL) GROUP BY
    ALL
""",
)
def entity_exact_merge(spark, sf_dir):
    """Every word of plain letters as a mention under its own spelling; spellings of one name meet."""
    words = F.regexp_extract_all("full_text", F.lit("[A-Za-z]+"), F.lit(0))
    m = load(spark, sf_dir, "v_messages").select("conv_id", "turn", F.posexplode(words).alias("ix", "name"))
    mentions = m.select(
        "conv_id", "turn", F.lit(7).alias("source"), F.col("ix").cast("bigint").alias("ix"), F.col("name").alias("key"),
        "name", F.lit("tech").alias("type"),
    )
    raw = E.raw_entities(mentions)
    return E.entities_of(raw, E.resolve_exact(raw)).select(
        "conv_id", "low", "name", "mention_count", "first_turn", "last_turn"
    )


@query("entity_alias_merge", "E10")
def entity_alias_merge(spark, sf_dir):
    mentions = saved(E.all_mentions(messages(spark, sf_dir), dictionary(spark, sf_dir)), "mentions")
    raw = saved(E.raw_entities(mentions), "raw")
    return E.entities_of(raw, E.resolve(raw)).select(
        "conv_id", "name", "type", F.array_join("aliases", "|").alias("aliases"), "mention_count", "first_turn", "last_turn"
    )


@query("cooccurrence_edges", "E11", "SELECT conv_id, src, dst, confidence, evidence FROM v_pairs", VIEWS)
def cooccurrence_edges(spark, sf_dir):
    _, mentions, _, resolved = graph_inputs(spark, sf_dir)
    return E.cooccurrence(mentions, resolved).drop("relationship")


@query("verb_edges", "E12")
def verb_edges(spark, sf_dir):
    m, _, raw, resolved = graph_inputs(spark, sf_dir)
    return E.verb_edges(m, E.entities_of(raw, resolved))


@query("entity_degrees", "E13", "SELECT * FROM v_degree", VIEWS)
def entity_degrees(spark, sf_dir):
    _, mentions, _, resolved = graph_inputs(spark, sf_dir)
    return E.degrees(E.cooccurrence(mentions, resolved))


@query(
    "entity_importance", "E14 E15",
    "SELECT conv_id, low, round(recency, 9) AS recency, degree, importance FROM v_scored_entities", VIEWS,
)
def entity_importance(spark, sf_dir):
    out, _, _ = scored(spark, sf_dir)
    return out.select("conv_id", "low", F.round("recency", 9).alias("recency"), "degree", "importance")


@query(
    "entity_rows", "E16",
    """
SELECT s.conv_id, s.name, s.type, s.first_turn AS first_mentioned_at, s.importance, coalesce(r.n, 0) AS relationships,
    coalesce(r.total, 0.0) AS confidence FROM v_scored_entities s LEFT JOIN (SELECT conv_id, src, count(*) AS n,
    round(sum(confidence), 4) AS total FROM v_pairs GROUP BY ALL) r ON r.conv_id = s.conv_id AND r.src = s.low
""",
    VIEWS,
)
def entity_rows(spark, sf_dir):
    out, relationships, _ = scored(spark, sf_dir)
    rows = E.entity_rows(out, relationships)
    total = F.aggregate("relationships", F.lit(0.0), lambda a, r: a + r["confidence"])
    return rows.select(
        "conv_id", "name", "type", "first_mentioned_at", "importance",
        F.coalesce(F.size("relationships"), F.lit(0)).cast("bigint").alias("relationships"),
        F.coalesce(F.round(total, 4), F.lit(0.0)).alias("confidence"),
    )


@query(
    "graph_edges", "E17",
    """
SELECT p.conv_id, src, dst, 'related_to' AS relationship, confidence AS weight FROM v_pairs p WHERE EXISTS (SELECT 1 FROM
    v_scored_entities s WHERE s.conv_id = p.conv_id AND s.low = p.src AND s.importance >= 0.3) AND EXISTS (SELECT 1 FROM
    v_scored_entities s WHERE s.conv_id = p.conv_id AND s.low = p.dst AND s.importance >= 0.3)
""",
    VIEWS,
)
def graph_edges(spark, sf_dir):
    out, relationships, _ = scored(spark, sf_dir)
    return E.graph(out.where(F.col("importance") >= 0.3), relationships)[1]


@query(
    "graph_nodes", "E17", "SELECT conv_id, low, name AS label, type AS \"group\" FROM v_scored_entities", VIEWS,
)
def graph_nodes(spark, sf_dir):
    out, relationships, _ = scored(spark, sf_dir)
    return E.graph(out, relationships)[0]


@query(
    "extraction_stats", "E18",
    """
SELECT r.conv_id, count(*) AS raw_entities, count(DISTINCT low) AS entities, coalesce(any_value(p.n), 0) AS relationships FROM
    v_resolved r LEFT JOIN (SELECT conv_id, count(*) AS n FROM v_pairs GROUP BY 1) p ON p.conv_id = r.conv_id GROUP BY
    r.conv_id
""",
    VIEWS,
)
def extraction_stats(spark, sf_dir):
    out, relationships, raw = scored(spark, sf_dir)
    return E.extraction_stats(raw, out, relationships)
