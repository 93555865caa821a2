"""Adapter views: the driver's tables in the shapes of the conversation domain.

`load` returns the DataFrame form; `SQL` holds the same views for a SQL engine and is what the oracle queries start
from.  Nothing here limits or samples: each view covers its whole table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions import text as T
from threadloom.functions.copies import by_repetition, value_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is; how files are split is a setting of the session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Users own fifty consecutive documents, so their number grows with the table.
USER = "CAST(floor(doc_id / 50) AS BIGINT)"
#: The gazetteer holds every word that one document in so many has.
TERM_SHARE = 4

SQL = {
    "v_messages": "SELECT conv_id, turn, role, text AS full_text FROM conversations",
    "v_docs": (
        "SELECT CAST(doc_id AS STRING) AS id, text AS content, lang, source, CAST(doc_id % 90 AS DOUBLE) AS age_days"
        " FROM documents"
    ),
    "v_queries": "SELECT item_id AS query_id, text AS query FROM benchmark",
    "v_sessions": (
        "SELECT o_orderkey AS session_id, o_custkey AS user_id,"
        " CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 25 END AS team_id, o_orderpriority AS source_llm,"
        " o_orderstatus = 'F' AS is_archived, CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate END AS deleted_at,"
        " o_orderdate AS created_at, o_orderkey % 40 AS message_count,"
        " CAST(floor(o_totalprice) AS BIGINT) AS total_tokens FROM orders"
    ),
    "v_shifts": (
        "SELECT o.o_custkey AS user_id, l.l_returnflag AS source_llm, l.l_linestatus AS target_llm,"
        " CAST(floor(l.l_quantity) AS BIGINT) AS source_tokens,"
        " CAST(floor(l.l_extendedprice / 100) AS BIGINT) AS target_tokens, l.l_shipdate AS created_at"
        " FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"
    ),
    "v_contexts": (
        "SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,"
        " l_suppkey, l_shipdate, l_extendedprice) AS version, CAST(floor(l_extendedprice) AS BIGINT) AS"
        " blob_size_bytes, l_discount AS compression_ratio, l_shipdate AS created_at FROM lineitem"
    ),
    "v_versions": (
        "SELECT o_orderkey AS id, o_custkey AS graph_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY"
        " o_orderdate, o_orderkey) AS parent_id,"
        " CASE WHEN o_orderkey % 5 = 0 THEN 'experiment' ELSE 'main' END AS branch FROM orders"
    ),
    "v_users": (
        "SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'pro_team'"
        " ELSE 'enterprise' END AS tier FROM customer"
    ),
    "v_teams": "SELECT n_nationkey AS team_id, n_name AS name, n_regionkey <> 4 AS is_active FROM nation",
    "v_team_members": (
        "SELECT c_nationkey AS team_id, c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN"
        " 'admin' WHEN 2 THEN 'member' ELSE 'viewer' END AS role FROM customer"
    ),
    "v_audit": (
        "SELECT event_id AS id, user_id, event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'session' ELSE"
        " 'context' END AS resource_type, event_id % 100 AS resource_id, ts AS created_at FROM events"
    ),
    "v_usage_events": (
        "SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'shifts' WHEN 'view' THEN 'brain_queries'"
        " WHEN 'click' THEN 'auto_captures' WHEN 'signup' THEN 'consensus_trials' ELSE 'tokens_processed' END AS"
        " metric, CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) ELSE CAST(1 AS BIGINT) END AS"
        " amount FROM events"
    ),
    "v_requests": "SELECT user_id, ts, event_id AS request_id FROM events",
    "v_deliveries": "SELECT user_id AS webhook_id, ts, event_id, event_type <> 'error' AS success FROM events",
    "v_calls": (
        "SELECT user_id AS session_id, event_id AS call_id, CASE event_id % 4 WHEN 0 THEN 'openai/gpt-4o' WHEN 1 THEN"
        " 'openai/gpt-4o-mini' WHEN 2 THEN 'google/gemini-2.5-pro' ELSE 'unknown/model' END AS model_id,"
        " event_id % 3000 AS prompt_tokens, event_id % 700 AS completion_tokens FROM events"
    ),
    "v_answers": (
        "SELECT conv_id AS prompt_id, turn AS answer_id, text AS content FROM conversations WHERE role = 'assistant'"
    ),
    "v_tokens": (
        "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tok FROM documents"
    ),
    "v_session_entities": (
        f"SELECT {USER} AS user_id, doc_id AS session_seq, CAST(doc_id % 60 AS DOUBLE) AS age_days, tok AS name,"
        " CASE WHEN length(tok) % 2 = 0 THEN 'tech' ELSE 'concept' END AS type,"
        " least(1.0, count(*) / 20.0) AS importance FROM v_tokens GROUP BY doc_id, tok"
        f" UNION ALL SELECT {USER}, doc_id, CAST(doc_id % 60 AS DOUBLE), 'topic ' || lang, 'concept', 0.2 FROM documents"
    ),
    "v_decisions": (
        f"SELECT {USER} AS user_id, doc_id AS session_seq, 0 AS item_ix, text AS description,"
        " '' AS rationale, doc_id % 7 AS decided_at, CASE doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'superseded'"
        " ELSE 'reverted' END AS status FROM documents"
    ),
    "v_tasks": (
        f"SELECT {USER} AS user_id, doc_id AS session_seq, 0 AS item_ix, text AS description,"
        " CAST(doc_id % 60 AS DOUBLE) AS age_days, (doc_id % 10) / 10.0 AS priority,"
        " CASE doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'blocked' ELSE 'active' END AS status FROM documents"
    ),
    "v_gazetteer": (
        "SELECT tok AS term, upper(tok) AS canonical, 'tech' AS type FROM v_tokens GROUP BY tok"
        f" HAVING count(DISTINCT doc_id) * {TERM_SHARE} >= (SELECT count(*) FROM documents)"
    ),
    "v_embeddings": "SELECT CAST(vec_id AS STRING) AS id, embedding AS vector, label FROM embeddings",
}


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """Put the views a statement names in front of it as common table expressions, in dependency order."""
    known = {**SQL, **(extra or {})}
    used: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(known[name].replace(name, ""))
                used.append(name)

    need(sql)
    if not used:
        return sql
    ctes = ", ".join(f"{name} AS ({known[name]})" for name in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def _parsed(spark: SparkSession, sf_dir: str, name: str, *bases: str) -> DataFrame:
    """Run a view's text in Spark SQL with the base tables bound to the parquet files."""
    frames = {b: table(spark, sf_dir, b) for b in bases}
    text = SQL[name]
    for b in bases:
        text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **frames)


_BASES = {
    "v_messages": ("conversations",),
    "v_docs": ("documents",),
    "v_queries": ("benchmark",),
    "v_sessions": ("orders",),
    "v_shifts": ("lineitem", "orders"),
    "v_users": ("customer",),
    "v_teams": ("nation",),
    "v_team_members": ("customer",),
    "v_audit": ("events",),
    "v_usage_events": ("events",),
    "v_requests": ("events",),
    "v_deliveries": ("events",),
    "v_calls": ("events",),
    "v_answers": ("conversations",),
    "v_decisions": ("documents",),
    "v_tasks": ("documents",),
    "v_embeddings": ("embeddings",),
}


def session_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_session_entities with `item_ix`, an entity's place in its session by name.

    A document whose id is its own is counted and numbered where it is read: no word of it is shuffled.
    """
    # One entity per document that its text does not name: no token holds a blank.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("topic "), "lang").alias("topic"))
    once, copies = by_repetition(docs, "doc_id")
    tokens = F.coalesce(T.terms("text"), F.array().cast("array<string>"))
    counted = value_counts(once.select("doc_id", F.concat(tokens, F.array("topic")).alias("s")), "s")
    rows = counted.select("doc_id", F.posexplode("s").alias("at", "v")).select(
        "doc_id", F.col("v.value").alias("name"), F.col("v.n").alias("n"), (F.col("at") + 1).alias("item_ix")
    )
    if copies is not None:
        counted = copies.select("doc_id", F.explode(T.terms("text")).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))
        both = counted.unionByName(copies.select("doc_id", F.col("topic").alias("name"), F.lit(1).cast("bigint").alias("n")))
        within = Window.partitionBy("doc_id").orderBy("name")
        rows = rows.unionByName(both.withColumn("item_ix", F.row_number().over(within)))
    topic = F.coalesce(F.contains("name", F.lit(" ")), F.lit(True))
    kind = F.when(~topic & (F.length("name") % 2 == 0), "tech").otherwise("concept")
    return rows.select(
        F.expr(USER).alias("user_id"),
        F.col("doc_id").alias("session_seq"),
        (F.col("doc_id") % 60).cast("double").alias("age_days"),
        "name",
        kind.alias("type"),
        F.when(topic, 0.2).otherwise(F.least(F.lit(1.0), F.col("n") / F.lit(20.0))).alias("importance"),
        "item_ix",
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The two views with a window are cut along their order here, because one key may hold a third of the rows.
    if name == "v_contexts":
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
        bucket = F.struct(F.col("l_linenumber").alias("n"), F.floor(F.col("l_partkey") / 1024).alias("p"))
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", *order)
        return ordered.running_sum(lines, ["l_orderkey"], order, F.lit(1), bucket, "nth").selectExpr(
            "l_orderkey AS session_id", "CAST(nth AS INT) AS version", "CAST(floor(l_extendedprice) AS BIGINT) AS blob_size_bytes",
            "l_discount AS compression_ratio", "l_shipdate AS created_at",
        )
    if name == "v_versions":
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        days = F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
        paired = ordered.previous(
            orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"], F.floor(days / 365), "before"
        )
        return paired.selectExpr(
            "o_orderkey AS id", "o_custkey AS graph_id", "before.o_orderkey AS parent_id",
            "CASE WHEN o_orderkey % 5 = 0 THEN 'experiment' ELSE 'main' END AS branch",
        )
    if name in _BASES:
        df = _parsed(spark, sf_dir, name, *_BASES[name])
        if name == "v_tasks":
            df = df.withColumn("priority", F.col("priority").cast("double"))
        return df
    if name == "v_tokens":
        docs = table(spark, sf_dir, "documents")
        return docs.select("doc_id", F.explode(T.terms("text")).alias("tok"))
    if name == "v_session_entities":
        return session_entities(spark, sf_dir).drop("item_ix")
    if name == "v_gazetteer":
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        once, copies = by_repetition(docs, "doc_id")
        # A document's words are made distinct where it is read; only ids that come again need a shuffle of their words.
        tokens = once.select(F.explode(F.array_distinct(T.terms("text"))).alias("tok"))
        if copies is not None:
            tokens = tokens.unionByName(copies.select("doc_id", F.explode(T.terms("text")).alias("tok")).distinct().select("tok"))
        by_doc = tokens.groupBy("tok").agg(F.count("*").alias("df"))
        n = docs.count()
        often = by_doc.where(F.col("df") * TERM_SHARE >= n)
        return often.select(F.col("tok").alias("term"), F.upper("tok").alias("canonical"), F.lit("tech").alias("type"))
    raise KeyError(name)
