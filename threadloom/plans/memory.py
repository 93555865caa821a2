"""Registered cross-session memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import chains, fixed

from threadloom.operators import memory as M
from threadloom.plans.registry import query
from threadloom.plans.summaries import sql_strip, sql_terms
from threadloom.session import saved
from threadloom.sources.testviews import USER, load, session_entities, table

DECAY = (
    "round(least(1.0, greatest(0.05, least(1.0, {imp}) * exp(-ln(2.0) / 30 * greatest({age}, 0.0)))), 6)"
)
OPPOSING = ", ".join(
    f"('{a}', '{b}')"
    for a, b in sorted(
        {(x, y) for l, r in fixed.OPPOSING_CHOICES for x in l for y in r}
        | {(y, x) for l, r in fixed.OPPOSING_CHOICES for x in l for y in r}
    )
)

#: Task chains stay inside blocks of sixty documents.
OWNER = "CAST(floor(doc_id / 60) AS BIGINT)"

VIEWS = {
    "v_ents": (
        "SELECT user_id, session_seq, age_days, type, importance, CASE WHEN session_seq % 2 = 0 THEN upper(name) ELSE"
        " name END AS name, CASE WHEN length(name) >= 9 THEN [substr(name, 1, 6)] ELSE CAST([] AS VARCHAR[]) END AS"
        " aliases, CAST(row_number() OVER (PARTITION BY session_seq ORDER BY name) AS INT) AS item_ix,"
        " CAST(length(name) % 7 AS INT) AS first_mentioned_at FROM v_session_entities"
    ),
    "v_keyed": (
        f"SELECT *, {sql_strip('lower(name)')} AS key, {DECAY.format(imp='importance', age='age_days')} AS decayed FROM"
        " v_ents"
    ),
    "v_first": (
        "SELECT user_id, key, min({'s': session_seq, 'i': item_ix}) AS first_seen FROM v_keyed GROUP BY ALL"
    ),
    "v_hits": (
        "SELECT a.user_id, a.alias AS key, a.name AS added FROM (SELECT user_id, key AS own, name, {'s': session_seq,"
        " 'i': item_ix} AS seen, lower(unnest(aliases)) AS alias FROM v_keyed) a JOIN v_first f ON f.user_id = a.user_id"
        " AND f.key = a.alias WHERE a.alias <> a.own AND f.first_seen < a.seen"
    ),
    "v_alias_sets": (
        "SELECT user_id, key, list(DISTINCT alias) AS found FROM (SELECT user_id, key, unnest(aliases) AS alias FROM"
        " v_keyed UNION ALL SELECT user_id, key, added FROM v_hits UNION ALL SELECT user_id, key, name FROM (SELECT"
        " user_id, key, name, row_number() OVER (PARTITION BY user_id, key ORDER BY session_seq, item_ix) AS nth FROM"
        " v_keyed) WHERE nth > 1) GROUP BY ALL"
    ),
    "v_merged": (
        "SELECT w.user_id, w.key, w.name, w.type, w.first_mentioned_at, coalesce(array_to_string(list_sort(list_filter("
        "a.found, lambda x: x <> w.name)), ','), '') AS aliases, round(least(1.0, w.decayed), 4) AS importance,"
        " s.session_count, s.mentions FROM (SELECT * FROM v_keyed QUALIFY row_number() OVER (PARTITION BY user_id, key"
        " ORDER BY decayed DESC, session_seq, item_ix) = 1) w JOIN (SELECT user_id, key, count(DISTINCT session_seq) AS"
        " session_count, count(*) AS mentions FROM v_keyed GROUP BY ALL) s ON s.user_id = w.user_id AND s.key = w.key"
        " LEFT JOIN v_alias_sets a ON a.user_id = w.user_id AND a.key = w.key"
    ),
    "v_edges": (
        "SELECT user_id, session_seq, name AS src_name, substr(name, 1, 6) AS dst_name, 'related_to' AS type FROM v_ents"
        " WHERE length(name) >= 9"
    ),
    "v_memory_sessions": (
        f"SELECT {USER} AS user_id, doc_id AS session_seq, doc_id % 40 AS message_count, n_chars // 4 AS total_tokens"
        " FROM documents"
    ),
    "v_prefs": (
        f"SELECT {USER} AS user_id, doc_id AS session_seq, CAST(doc_id % 60 AS DOUBLE) AS age_days, CASE doc_id % 3"
        " WHEN 0 THEN 'formal' WHEN 1 THEN 'casual' ELSE 'technical' END AS tone, CASE doc_id % 2 WHEN 0 THEN 'concise'"
        " ELSE 'detailed' END AS detail_level, lang, source FROM documents"
    ),
    "v_dkeyed": f"SELECT *, {sql_strip('lower(description)')} AS key FROM v_decisions",
    "v_tkeyed": f"SELECT * EXCLUDE (priority), CAST(priority AS DOUBLE) AS priority, {sql_strip('lower(description)')} AS key FROM v_tasks",
    "v_opposing": f"SELECT * FROM (VALUES {OPPOSING}) AS t(word, against)",
    "v_active": (
        "SELECT user_id, session_seq, item_ix, description, list_distinct("
        + sql_terms("description || ' ' || rationale")
        + ") AS tokens FROM v_tech_decisions WHERE status = 'active'"
    ),
    # Decisions that name technologies now and then, so that opposing choices occur.
    "v_tech_decisions": (
        "SELECT * EXCLUDE (rationale), CASE session_seq % 9 WHEN 0 THEN 'use rest' WHEN 3 THEN 'use graphql' ELSE '' END"
        " AS rationale FROM v_decisions"
    ),
    "v_conflicts": (
        "SELECT user_id, session_a, item_a, decision_a, session_b, item_b, decision_b, round(overlap, 4) AS overlap_score,"
        " CASE WHEN opposing THEN 'opposing_choice' ELSE 'scope_overlap' END AS conflict_type FROM (SELECT a.user_id,"
        " a.session_seq AS session_a, a.item_ix AS item_a, a.description AS decision_a, b.session_seq AS session_b,"
        " b.item_ix AS item_b, b.description AS decision_b, CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.0 ELSE"
        " len(list_intersect(a.tokens, b.tokens)) / CAST(len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens,"
        " b.tokens)) AS DOUBLE) END AS overlap, EXISTS (SELECT 1 FROM v_opposing o WHERE list_contains(a.tokens, o.word)"
        " AND list_contains(b.tokens, o.against)) AS opposing FROM v_active a JOIN v_active b ON a.user_id = b.user_id AND"
        " a.session_seq < b.session_seq) WHERE opposing OR overlap >= 0.1"
    ),
    "v_counts": (
        "SELECT user_id, key, count(DISTINCT session_seq) AS sessions, max(importance) AS importance, arg_min(name,"
        " session_seq) AS name FROM (SELECT * FROM v_keyed QUALIFY row_number() OVER (PARTITION BY user_id, key,"
        " session_seq ORDER BY item_ix) = 1) GROUP BY ALL"
    ),
    "v_undecided": (
        "SELECT user_id, 'undecided_topic' AS gap_type, key AS subject, CASE WHEN sessions >= 3 THEN 'high' ELSE 'medium'"
        " END AS severity, sessions AS session_count FROM v_counts c WHERE sessions >= 2 AND NOT EXISTS (SELECT 1 FROM"
        " v_decisions d WHERE d.user_id = c.user_id AND contains(lower(d.description), c.key))"
    ),
    "v_stalled": (
        "SELECT user_id, 'stalled_task' AS gap_type, description AS subject, CASE WHEN age_days >= 28 THEN 'high' ELSE"
        " 'medium' END AS severity, CAST(1 AS BIGINT) AS session_count FROM (SELECT * FROM v_tkeyed t WHERE status ="
        " 'active' AND NOT EXISTS (SELECT 1 FROM v_tkeyed c WHERE c.user_id = t.user_id AND c.key = t.key AND c.status ="
        " 'completed') QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY age_days DESC, session_seq) = 1)"
        " WHERE age_days >= 14"
    ),
    "v_unclear": (
        "SELECT user_id, 'unclear_entity' AS gap_type, name AS subject, 'low' AS severity, sessions AS session_count FROM"
        " v_counts WHERE sessions >= 3 AND importance < 0.3"
    ),
    "v_distinct": (
        "SELECT u.user_id, (SELECT count(DISTINCT key) FROM v_keyed k WHERE k.user_id = u.user_id) AS total_entities,"
        " (SELECT count(DISTINCT key) FROM v_dkeyed k WHERE k.user_id = u.user_id) AS total_decisions, (SELECT"
        " count(DISTINCT key) FROM v_tkeyed k WHERE k.user_id = u.user_id) AS total_tasks FROM (SELECT DISTINCT user_id"
        " FROM v_memory_sessions) u"
    ),
    "v_digest_entities": (
        "SELECT user_id, 'entity' AS category, name AS title, type || ' entity (importance: ' || printf('%.2f',"
        " importance) || ')' AS detail, CAST(importance AS DOUBLE) AS importance FROM (SELECT * FROM (SELECT * FROM v_keyed"
        " QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY importance DESC, session_seq, item_ix) = 1) WHERE"
        " importance >= 0.3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, key) <= 10)"
    ),
    "v_digest_decisions": (
        "SELECT user_id, 'decision' AS category, substr(description, 1, 80) AS title, 'No rationale provided' AS detail,"
        " CAST(0.7 AS DOUBLE) AS importance FROM (SELECT * FROM (SELECT * FROM v_dkeyed WHERE status = 'active' QUALIFY"
        " row_number() OVER (PARTITION BY user_id, key ORDER BY session_seq, item_ix) = 1) QUALIFY row_number() OVER"
        " (PARTITION BY user_id ORDER BY session_seq, item_ix) <= 10)"
    ),
    "v_digest_tasks": (
        "SELECT user_id, 'task' AS category, substr(description, 1, 80) AS title, 'Status: ' || status || ', Priority: ' ||"
        " printf('%.1f', priority) AS detail, priority AS importance FROM (SELECT * FROM (SELECT *, min(session_seq) OVER"
        " (PARTITION BY user_id, key) AS seen FROM v_tkeyed QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY"
        " CASE WHEN status = 'completed' THEN 1 ELSE 0 END DESC, CASE WHEN status = 'completed' THEN -session_seq ELSE"
        " session_seq END) = 1) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen) <= 10)"
    ),
    "v_conv_tokens": (
        "SELECT conv_id, unnest(regexp_extract_all(full_text, '[A-Za-z]+')) AS name FROM v_messages"
    ),
    "v_links": (
        f"SELECT {OWNER} AS user_id, doc_id AS node, CASE WHEN doc_id % 120 = 100 THEN NULL WHEN doc_id % 60 IN (0, 20)"
        " THEN doc_id + 20 WHEN doc_id % 60 = 40 THEN doc_id - 40 WHEN doc_id % 60 > 20 THEN doc_id - 20 END AS next FROM"
        " documents"
    ),
}


def entities(spark, sf_dir):
    return session_entities(spark, sf_dir).select(
        "user_id",
        "session_seq",
        "item_ix",
        "age_days",
        F.when(F.col("session_seq") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
        "type",
        "importance",
        F.when(F.length("name") >= 9, F.array(F.substring("name", 1, 6)))
        .otherwise(F.array().cast("array<string>"))
        .alias("aliases"),
        (F.length("name") % 7).alias("first_mentioned_at"),
    )



def shared_entities(spark, sf_dir):
    """The entities as a written table, for queries that read them more than once."""
    return saved(entities(spark, sf_dir), "entities")


def edges(spark, sf_dir, e=None):
    e = entities(spark, sf_dir) if e is None else e
    e = e.where(F.length("name") >= 9)
    return e.select(
        "user_id", "session_seq", F.col("name").alias("src_name"), F.substring("name", 1, 6).alias("dst_name"),
        F.lit("related_to").alias("type"),
    )


def sessions(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        f"{USER} AS user_id", "doc_id AS session_seq", "doc_id % 40 AS message_count", "n_chars div 4 AS total_tokens"
    )


def decisions(spark, sf_dir):
    return load(spark, sf_dir, "v_decisions")


def tech_decisions(spark, sf_dir):
    rationale = F.expr("CASE session_seq % 9 WHEN 0 THEN 'use rest' WHEN 3 THEN 'use graphql' ELSE '' END")
    return decisions(spark, sf_dir).withColumn("rationale", rationale)


def tasks(spark, sf_dir):
    return load(spark, sf_dir, "v_tasks")


@query(
    "temporal_decay", "B1 B2",
    f"""
SELECT session_seq, name, {DECAY.format(imp='importance + 0.1 * (session_seq % 4)', age='age_days - 2')} AS decayed FROM
    v_ents
""",
    VIEWS,
)
def temporal_decay(spark, sf_dir):
    e = entities(spark, sf_dir)
    score = M.decayed(F.col("importance"), F.col("age_days") - 2, F.col("session_seq") % 4)
    return e.select("session_seq", "name", score.alias("decayed"))


@query("entity_merge", "B3", "SELECT * FROM v_merged", VIEWS)
def entity_merge(spark, sf_dir):
    return M.merge_entities(shared_entities(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", ","))


@query("alias_hits", "B4", "SELECT user_id, key, added, count(*) AS n FROM v_hits GROUP BY ALL", VIEWS)
def alias_hits(spark, sf_dir):
    return M.alias_hits(shared_entities(spark, sf_dir)).groupBy("user_id", "key", "added").agg(F.count("*").alias("n"))


@query(
    "decision_merge", "B5",
    """
SELECT user_id, key, description, rationale, decided_at, status, session_seq, item_ix FROM v_dkeyed QUALIFY row_number()
    OVER (PARTITION BY user_id, key ORDER BY status = 'active' DESC, CASE WHEN status = 'active' THEN session_seq ELSE
    decided_at END DESC, session_seq) = 1
""",
    VIEWS,
)
def decision_merge(spark, sf_dir):
    return M.merge_decisions(decisions(spark, sf_dir))


@query(
    "task_merge", "B6",
    """
SELECT user_id, key, description, status, priority, session_seq, item_ix FROM v_tkeyed QUALIFY row_number() OVER
    (PARTITION BY user_id, key ORDER BY status = 'completed' DESC, CASE WHEN status = 'completed' THEN
    CAST(session_seq AS DOUBLE) ELSE priority END DESC, session_seq) = 1
""",
    VIEWS,
)
def task_merge(spark, sf_dir):
    return M.merge_tasks(tasks(spark, sf_dir))


@query(
    "preference_merge", "B7",
    """
WITH f AS (SELECT user_id, k, arg_max(v, session_seq) AS v FROM (SELECT user_id, session_seq, 'code' AS k, lang AS v FROM
    v_prefs UNION ALL SELECT user_id, session_seq, 'layout_' || (session_seq % 3), source FROM v_prefs) GROUP BY 1, 2)
SELECT p.user_id, p.tone, p.detail_level, d.domains, x.formats FROM (SELECT * FROM v_prefs QUALIFY row_number() OVER
    (PARTITION BY user_id ORDER BY age_days, session_seq) = 1) p
JOIN (SELECT user_id, string_agg(v, ',' ORDER BY v) AS domains FROM (SELECT DISTINCT user_id, unnest([lang, source]) AS v
    FROM v_prefs) GROUP BY 1) d ON d.user_id = p.user_id
JOIN (SELECT user_id, string_agg(k || '=' || v, ',' ORDER BY k) AS formats FROM f GROUP BY 1) x ON x.user_id = p.user_id
""",
    VIEWS,
)
def preference_merge(spark, sf_dir):
    prefs = table(spark, sf_dir, "documents").selectExpr(
        f"{USER} AS user_id", "doc_id AS session_seq", "CAST(doc_id % 60 AS DOUBLE) AS age_days",
        "CASE doc_id % 3 WHEN 0 THEN 'formal' WHEN 1 THEN 'casual' ELSE 'technical' END AS tone",
        "CASE doc_id % 2 WHEN 0 THEN 'concise' ELSE 'detailed' END AS detail_level",
        "array(lang, source) AS domain_expertise",
        "map('code', lang, concat('layout_', doc_id % 3), source) AS format_preferences",
    )
    merged = M.merge_preferences(prefs)
    pairs = F.transform(F.map_entries("format_preferences"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select(
        "user_id", "tone", "detail_level", F.array_join("domain_expertise", ",").alias("domains"),
        F.array_join(pairs, ",").alias("formats"),
    )


@query(
    "unified_graph", "B8",
    """
SELECT e.user_id, e.src_key, e.dst_key, e.relationship, m.importance AS weight FROM (SELECT DISTINCT user_id,
    lower(src_name) AS src_key, lower(dst_name) AS dst_key, type AS relationship FROM v_edges) e JOIN v_merged m ON
    m.user_id = e.user_id AND m.key = e.src_key WHERE EXISTS (SELECT 1 FROM v_merged t WHERE t.user_id = e.user_id AND
    t.key = e.dst_key)
""",
    VIEWS,
)
def unified_graph(spark, sf_dir):
    e = shared_entities(spark, sf_dir)
    return M.unified_graph(M.merge_entities(e), edges(spark, sf_dir, e))


@query(
    "consolidation_totals", "B9",
    """
SELECT s.user_id, s.session_count, CAST(s.message_count AS BIGINT) AS message_count, CAST(s.total_tokens AS BIGINT) AS
    total_tokens, d.total_entities AS entity_count, d.total_decisions AS decision_count, d.total_tasks AS task_count,
    (SELECT count(*) FROM v_keyed k WHERE k.user_id = s.user_id) - d.total_entities + (SELECT count(*) FROM v_hits h WHERE
    h.user_id = s.user_id) AS entities_merged
FROM (SELECT user_id, count(*) AS session_count, sum(message_count) AS message_count, sum(total_tokens) AS total_tokens
    FROM v_memory_sessions GROUP BY 1) s JOIN v_distinct d ON d.user_id = s.user_id
""",
    VIEWS,
)
def consolidation_totals(spark, sf_dir):
    return M.consolidation_totals(
        sessions(spark, sf_dir), shared_entities(spark, sf_dir), decisions(spark, sf_dir), tasks(spark, sf_dir)
    )


@query(
    "conflict_groups", "B10",
    """
SELECT user_id, least(ta, tb) AS text_low, greatest(ta, tb) AS text_high, overlap_score, conflict_type, count(*) AS pairs
FROM (SELECT c.*, decision_a || ' ' || x.rationale AS ta, decision_b || ' ' || y.rationale AS tb FROM v_conflicts c
    JOIN v_tech_decisions x ON x.session_seq = c.session_a AND x.item_ix = c.item_a
    JOIN v_tech_decisions y ON y.session_seq = c.session_b AND y.item_ix = c.item_b) GROUP BY ALL
""",
    VIEWS,
)
def conflict_groups(spark, sf_dir):
    return M.conflict_groups(tech_decisions(spark, sf_dir))


@query("conflict_pairs", "B10", "SELECT * FROM v_conflicts", VIEWS)
def conflict_pairs(spark, sf_dir):
    return M.conflict_pairs(tech_decisions(spark, sf_dir))


@query(
    "conflicts_for_entity", "B11",
    """
SELECT user_id, session_a, session_b, conflict_type FROM v_conflicts WHERE contains(lower(decision_a), 'the') OR
    contains(lower(decision_b), 'the')
""",
    VIEWS,
)
def conflicts_for_entity(spark, sf_dir):
    out = M.conflicts_for_entity(tech_decisions(spark, sf_dir), "The")
    return out.select("user_id", "session_a", "session_b", "conflict_type")


@query("undecided_topics", "B12", "SELECT * FROM v_undecided", VIEWS)
def undecided_topics(spark, sf_dir):
    return M.undecided_topics(entities(spark, sf_dir), decisions(spark, sf_dir))


@query("stalled_tasks", "B13", "SELECT * FROM v_stalled", VIEWS)
def stalled_tasks(spark, sf_dir):
    return M.stalled_tasks(tasks(spark, sf_dir))


@query("unclear_entities", "B14", "SELECT * FROM v_unclear", VIEWS)
def unclear_entities(spark, sf_dir):
    return M.unclear_entities(entities(spark, sf_dir))


@query(
    "gap_report", "B15",
    """
SELECT g.user_id, gap_type, severity, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INT) AS
    severity_order, count(*) AS gaps, any_value(total_entities) AS total_entities, any_value(total_decisions) AS
    total_decisions, any_value(total_tasks) AS total_tasks FROM (SELECT * FROM v_undecided UNION ALL SELECT * FROM v_stalled
    UNION ALL SELECT * FROM v_unclear) g JOIN v_distinct d ON d.user_id = g.user_id GROUP BY 1, 2, 3, 4
""",
    VIEWS,
)
def gap_report(spark, sf_dir):
    e, d, t = shared_entities(spark, sf_dir), decisions(spark, sf_dir), tasks(spark, sf_dir)
    report = M.gap_report(e, d, t)
    counted = report.groupBy("user_id", "gap_type", "severity", "severity_order").agg(F.count("*").alias("gaps"))
    return counted.join(M.distinct_counts(e, d, t), "user_id")


@query("digest_entities", "B16", "SELECT * FROM v_digest_entities", VIEWS)
def digest_entities(spark, sf_dir):
    return M.digest_entities(entities(spark, sf_dir))


@query("digest_decisions", "B17", "SELECT * FROM v_digest_decisions", VIEWS)
def digest_decisions(spark, sf_dir):
    return M.digest_decisions(decisions(spark, sf_dir))


@query("digest_tasks", "B18", "SELECT * FROM v_digest_tasks", VIEWS)
def digest_tasks(spark, sf_dir):
    return M.digest_tasks(tasks(spark, sf_dir))


@query(
    "digest", "B19",
    """
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, category, title, detail) AS INT) AS place
FROM (SELECT * FROM v_digest_entities UNION ALL SELECT * FROM v_digest_decisions UNION ALL SELECT * FROM v_digest_tasks)
""",
    VIEWS,
)
def digest(spark, sf_dir):
    return M.digest(entities(spark, sf_dir), decisions(spark, sf_dir), tasks(spark, sf_dir))


@query(
    "digest_stats", "B19",
    """
SELECT s.user_id, count(*) AS session_count, any_value(d.total_entities) AS new_entities, (SELECT count(DISTINCT key) FROM
    v_dkeyed k WHERE k.user_id = s.user_id AND status = 'active') AS decisions_made, (SELECT count(*) FROM v_tkeyed k WHERE
    k.user_id = s.user_id AND status = 'completed') AS tasks_completed, CAST(sum(message_count) AS BIGINT) AS
    total_messages FROM v_memory_sessions s JOIN v_distinct d ON d.user_id = s.user_id GROUP BY s.user_id
""",
    VIEWS,
)
def digest_stats(spark, sf_dir):
    return M.digest_stats(
        sessions(spark, sf_dir), entities(spark, sf_dir), decisions(spark, sf_dir), tasks(spark, sf_dir)
    )


@query(
    "recent_sessions", "B20",
    "SELECT session_id, user_id FROM v_sessions WHERE created_at >= TIMESTAMP '1998-01-01 12:00:00' - INTERVAL 90 DAY",
)
def recent_sessions(spark, sf_dir):
    out = M.recent_sessions(load(spark, sf_dir, "v_sessions"), "1998-01-01 12:00:00", 90)
    return out.orderBy(F.desc("created_at"), "session_id").select("session_id", "user_id")


@query(
    "integrity_violations", "B21",
    """
WITH n AS (SELECT user_id, name AS label FROM v_ents UNION ALL SELECT CAST(floor(doc_id / 50) AS BIGINT), 'ghost' || doc_id FROM documents),
t AS (SELECT CAST(floor(doc_id / 50) AS BIGINT) AS user_id, doc_id, unnest([doc_id - 20, doc_id + 40]) AS dep FROM documents),
names AS (SELECT DISTINCT user_id, name FROM v_ents), labels AS (SELECT DISTINCT user_id, label FROM n)
SELECT user_id, 'relationship_target' AS check, src_name AS owner, dst_name AS ref FROM v_edges e WHERE NOT EXISTS (SELECT 1
    FROM names x WHERE x.user_id = e.user_id AND x.name = e.dst_name)
UNION ALL SELECT user_id, 'graph_node', label, label FROM n WHERE NOT EXISTS (SELECT 1 FROM names x WHERE x.user_id =
    n.user_id AND x.name = n.label)
UNION ALL SELECT user_id, 'edge_source', dst_name, src_name FROM v_edges e WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE
    x.user_id = e.user_id AND x.label = e.src_name)
UNION ALL SELECT user_id, 'edge_target', src_name, dst_name FROM v_edges e WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE
    x.user_id = e.user_id AND x.label = e.dst_name)
UNION ALL SELECT user_id, 'task_dependency', CAST(doc_id AS VARCHAR), CAST(dep AS VARCHAR) FROM t WHERE dep NOT IN (SELECT
    doc_id FROM documents) OR floor(dep / 50) <> user_id
UNION ALL SELECT user_id, 'superseded_by', CAST(session_seq AS VARCHAR), CAST(session_seq + 20 AS VARCHAR) FROM v_decisions
    WHERE status = 'superseded' AND (session_seq + 20 NOT IN (SELECT doc_id FROM documents) OR floor((session_seq + 20) / 50) <> user_id)
""",
    VIEWS,
)
def integrity_violations(spark, sf_dir):
    e = saved(entities(spark, sf_dir).select("user_id", "session_seq", "name"), "names")
    links = edges(spark, sf_dir, e)
    docs = table(spark, sf_dir, "documents")
    ghosts = docs.selectExpr(f"{USER} AS user_id", "concat('ghost', doc_id) AS label")
    todo = docs.selectExpr(
        f"{USER} AS user_id", "doc_id AS task_id", "array(doc_id - 20, doc_id + 40) AS dependencies"
    )
    decided = decisions(spark, sf_dir).selectExpr(
        "user_id", "session_seq AS decision_id", "CASE WHEN status = 'superseded' THEN session_seq + 20 END AS superseded_by"
    )
    # Every entity is a node of the graph, and so are the ghosts.
    return M.integrity_violations(e, links, ghosts, links, todo, decided, entity_nodes=True)


@query(
    "quality_warnings", "B22",
    """
WITH d AS (SELECT conv_id, count(*) AS message_count FROM v_messages GROUP BY 1),
e AS (SELECT DISTINCT conv_id, name FROM v_conv_tokens WHERE length(name) <> 12)
SELECT conv_id, 'no_global_summary' AS warning, CAST(NULL AS VARCHAR) AS subject FROM d WHERE conv_id % 7 = 0
UNION ALL SELECT conv_id, 'ratio_not_positive', NULL FROM d WHERE conv_id % 10 = 0
UNION ALL SELECT conv_id, 'orphan_score', name FROM (SELECT DISTINCT conv_id, name FROM v_conv_tokens) WHERE length(name) =
    12
UNION ALL SELECT DISTINCT conv_id, 'duplicate_names', NULL FROM (SELECT conv_id, lower(name) FROM e GROUP BY ALL HAVING
    count(*) > 1)
UNION ALL SELECT DISTINCT m.conv_id, 'topic_index_out_of_range', m.role FROM v_messages m JOIN d USING (conv_id) WHERE
    m.turn + m.conv_id % 3 >= d.message_count
""",
    VIEWS,
)
def quality_warnings(spark, sf_dir):
    m = load(spark, sf_dir, "v_messages")
    docs = m.groupBy("conv_id").agg(F.count("*").alias("message_count")).withColumn(
        "compression_ratio", F.when(F.col("conv_id") % 10 == 0, 0.0).otherwise(0.5)
    )
    levels = m.select("conv_id", F.when(F.col("conv_id") % 7 != 0, "global").otherwise("message").alias("level"))
    found = m.select(
        "conv_id", F.explode(F.regexp_extract_all("full_text", F.lit("[A-Za-z]+"), F.lit(0))).alias("entity")
    ).distinct()
    known = found.where(F.length("entity") != 12).select("conv_id", F.col("entity").alias("name"))
    topics = m.select(
        "conv_id", F.col("role").alias("label"), (F.col("turn") + F.col("conv_id") % 3).alias("message_index")
    )
    return M.quality_warnings(docs, levels, found, known, topics)


@query(
    "task_cycles", "B23",
    """
WITH RECURSIVE r(start, node) AS (SELECT node, next FROM v_links WHERE next IS NOT NULL UNION SELECT r.start, l.next FROM r
    JOIN v_links l ON l.node = r.node WHERE l.next IS NOT NULL)
SELECT DISTINCT CAST(floor(start / 60) AS BIGINT) AS user_id, start AS node FROM r WHERE node IN (SELECT start FROM r WHERE start = node)
""",
    VIEWS,
)
def task_cycles(spark, sf_dir):
    links = table(spark, sf_dir, "documents").selectExpr(
        f"{OWNER} AS user_id", "doc_id AS node",
        "CASE WHEN doc_id % 120 = 100 THEN NULL WHEN doc_id % 60 IN (0, 20) THEN doc_id + 20 WHEN doc_id % 60 = 40 THEN"
        " doc_id - 40 WHEN doc_id % 60 > 20 THEN doc_id - 20 END AS next",
    )
    return chains.leads_to_cycle(links, ["user_id"])
