"""Registered version-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from threadloom.operators import stores
from threadloom.operators import versions as V
from threadloom.plans.registry import query
from threadloom.session import shared_folder
from threadloom.sources.testviews import load, table

VIEWS = {
    "v_branches": (
        "SELECT DISTINCT c_custkey AS graph_id, branch, CAST(c_custkey AS BIGINT) * 1000000 AS base_id FROM customer,"
        " (VALUES ('main'), ('experiment')) b(branch)"
    ),
    "v_pairs": (
        "SELECT a.doc_id AS old_id, b.doc_id AS new_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20"
    ),
    "v_snapshots": (
        "SELECT p.old_id, p.new_id, name, max(CASE WHEN s.session_seq = p.old_id THEN importance END) AS old_i,"
        " max(CASE WHEN s.session_seq = p.new_id THEN importance END) AS new_i FROM v_pairs p JOIN v_session_entities s ON"
        " s.session_seq = p.old_id OR s.session_seq = p.new_id GROUP BY 1, 2, 3"
    ),
}


@query(
    "next_versions", "V1",
    """
SELECT s.session_id, CAST(coalesce(max(version), 0) + 1 AS BIGINT) AS next_version FROM v_sessions s LEFT JOIN v_contexts
    c USING (session_id) GROUP BY 1
""",
)
def next_versions(spark, sf_dir):
    out = V.next_versions(load(spark, sf_dir, "v_sessions"), load(spark, sf_dir, "v_contexts"))
    return out.withColumn("next_version", F.col("next_version").cast("bigint"))


@query(
    "version_list", "V2",
    """
SELECT session_id, CAST(version AS INT) AS version, blob_size_bytes, position, versions FROM (SELECT *,
    CAST(row_number() OVER (PARTITION BY session_id ORDER BY version DESC) AS INT) AS position, count(*) OVER (PARTITION BY
    session_id) AS versions FROM v_contexts) WHERE position > 1 AND position <= 4
""",
)
def version_list(spark, sf_dir):
    out = V.version_list(load(spark, sf_dir, "v_contexts"), 1, 3)
    return out.select("session_id", "version", "blob_size_bytes", "position", "versions")


@query(
    "snapshot_diff", "V3",
    """
SELECT p.old_id, p.new_id,
    coalesce((SELECT md5(string_agg(name, ',' ORDER BY name)) FROM v_snapshots s WHERE s.old_id = p.old_id AND old_i IS
    NULL), md5('')) AS added,
    coalesce((SELECT md5(string_agg(name, ',' ORDER BY name)) FROM v_snapshots s WHERE s.old_id = p.old_id AND new_i IS
    NULL), md5('')) AS removed,
    coalesce((SELECT md5(string_agg(name, ',' ORDER BY name)) FROM v_snapshots s WHERE s.old_id = p.old_id AND old_i <>
    new_i), md5('')) AS modified,
    CAST(o.description <> n.description AS BIGINT) AS decisions_added, CAST(o.description <> n.description AS BIGINT) AS
    decisions_removed, CAST(ot.description <> nt.description AS BIGINT) AS tasks_added, CAST(ot.description <>
    nt.description AS BIGINT) AS tasks_removed, p.new_id % 40 - p.old_id % 40 AS message_delta, od.lang <> nd.lang AS
    summary_changed
FROM v_pairs p JOIN v_decisions o ON o.session_seq = p.old_id JOIN v_decisions n ON n.session_seq = p.new_id
JOIN v_tasks ot ON ot.session_seq = p.old_id JOIN v_tasks nt ON nt.session_seq = p.new_id
JOIN documents od ON od.doc_id = p.old_id JOIN documents nd ON nd.doc_id = p.new_id
""",
    VIEWS,
)
def snapshot_diff(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    later = docs.select(F.col("doc_id").alias("new_id"))
    pairs = docs.selectExpr("doc_id AS old_id", "doc_id + 20 AS new_id").join(later, "new_id", "left_semi")
    entities = load(spark, sf_dir, "v_session_entities").selectExpr("session_seq AS version_id", "name", "importance")
    decisions = load(spark, sf_dir, "v_decisions").selectExpr("session_seq AS version_id", "description")
    tasks = load(spark, sf_dir, "v_tasks").selectExpr("session_seq AS version_id", "description")
    meta = docs.selectExpr("doc_id AS version_id", "doc_id % 40 AS message_count", "lang AS global_summary")
    out = V.diff(pairs, entities, decisions, tasks, meta)
    digest = {
        short: F.md5(F.array_join(f"entities_{short}", ",").cast("binary")) for short in ("added", "removed", "modified")
    }
    return out.withColumns(digest).drop("entities_added", "entities_removed", "entities_modified")


@query(
    "history_walk", "V4",
    """
WITH RECURSIVE heads AS (SELECT graph_id, max(id) AS start FROM v_versions GROUP BY 1),
w(graph_id, start, node, step) AS (SELECT graph_id, start, start, 0 FROM heads UNION ALL SELECT w.graph_id, w.start,
    v.parent_id, w.step + 1 FROM w JOIN v_versions v ON v.graph_id = w.graph_id AND v.id = w.node WHERE v.parent_id IS NOT
    NULL AND w.step < 49)
SELECT graph_id, start, node, CAST(step AS INT) AS step FROM w
""",
)
def history_walk(spark, sf_dir):
    versions = load(spark, sf_dir, "v_versions")
    heads = versions.groupBy("graph_id").agg(F.max("id").alias("start"))
    return V.history(versions, heads, 50)


@query(
    "current_versions", "V5",
    """
SELECT session_id, CAST(max(version) AS INT) AS version, arg_max(blob_size_bytes, version) AS blob_size_bytes FROM
    v_contexts GROUP BY 1
""",
)
def current_versions(spark, sf_dir):
    return V.current_versions(load(spark, sf_dir, "v_contexts")).select("session_id", "version", "blob_size_bytes")


@query(
    "branch_numbers", "V6",
    """
SELECT id, graph_id, branch, row_number() OVER (PARTITION BY graph_id, branch ORDER BY id) AS version_number FROM
    v_versions
""",
)
def branch_numbers(spark, sf_dir):
    return V.branch_numbers(load(spark, sf_dir, "v_versions")).select("id", "graph_id", "branch", "version_number")


def branches(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("graph_id"))
    return customers.select(
        "graph_id",
        F.explode(F.array(F.lit("main"), F.lit("experiment"))).alias("branch"),
        (F.col("graph_id") * 1000000).alias("base_id"),
    )


@query(
    "branch_heads", "V6",
    """
SELECT b.graph_id, b.branch, coalesce(max(v.id), any_value(b.base_id)) AS head_id, count(v.id) AS commits FROM v_branches b
    LEFT JOIN v_versions v ON v.graph_id = b.graph_id AND v.branch = b.branch GROUP BY 1, 2
""",
    VIEWS,
)
def branch_heads(spark, sf_dir):
    return V.branch_heads(branches(spark, sf_dir), load(spark, sf_dir, "v_versions"))


@query(
    "branch_archive", "V7",
    """
SELECT graph_id, branch, CASE WHEN branch <> 'main' AND graph_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus =
    'P') THEN 'archived' ELSE 'active' END AS status FROM v_branches
""",
    VIEWS,
)
def branch_archive(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("graph_id"))
    asked = pending.select("graph_id", F.explode(F.array(F.lit("main"), F.lit("experiment"))).alias("branch"))
    return V.archive_branches(branches(spark, sf_dir), asked)


@query(
    "storage_stats", "V8",
    """
SELECT session_id, CAST(sum(blob_size_bytes) AS BIGINT) AS stored_bytes, count(*) AS versions,
    round(avg(compression_ratio), 6) AS average_ratio FROM v_contexts GROUP BY 1
""",
)
def storage_stats(spark, sf_dir):
    out = V.storage_stats(load(spark, sf_dir, "v_contexts"))
    return out.withColumn("average_ratio", F.round("average_ratio", 6))


SINK = """
SELECT session_id, version, version = max(version) OVER (PARTITION BY session_id) AS is_current FROM (SELECT session_id,
    version FROM v_contexts UNION ALL SELECT o_orderkey, coalesce(m, 0) + 1 FROM orders LEFT JOIN (SELECT session_id,
    max(version) AS m FROM v_contexts GROUP BY 1) ON session_id = o_orderkey)
"""


def version_store(spark, sf_dir):
    """Two batches of a version store: the stored contexts, then one more context for each order."""
    path = shared_folder(spark, "version-store")
    first = load(spark, sf_dir, "v_contexts").selectExpr("session_id", "version AS arrival")
    stores.append_batch(first, path, 0)
    stores.append_batch(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS session_id", "o_orderkey AS arrival"), path, 1)
    return path, stores.with_columns(first.drop("arrival").schema, version=LongType())


@query("versioned_sink", "S10", SINK)
def versioned_sink(spark, sf_dir):
    path, schema = version_store(spark, sf_dir)
    return stores.stored_versions(spark, path, schema)


@query("versioned_sink_heads", "S10", f"SELECT session_id, version FROM ({SINK}) WHERE is_current")
def versioned_sink_heads(spark, sf_dir):
    """Current versions as they lie in the store."""
    path, schema = version_store(spark, sf_dir)
    return stores.stored_versions(spark, path, schema).where("is_current").drop("is_current")
