"""Registered reporting queries (usage, teams, audit, billing, cost)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import dims, fixed
from threadloom.operators import reports as R
from threadloom.plans.registry import query
from threadloom.sources.testviews import load

NOW = "1998-01-01 12:00:00"
PERIOD = "2024-01"


def values(rows) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def names(columns: str) -> str:
    return ", ".join(part.split()[0] for part in columns.split(","))


LOCAL = {
    "v_tiers": f"SELECT * FROM (VALUES {values(fixed.TIERS)}) AS t({names(fixed.TIER_COLUMNS)})",
    "v_policies": f"SELECT * FROM (VALUES {values(fixed.POLICIES)}) AS t({names(fixed.POLICY_COLUMNS)})",
    "v_prices": f"SELECT * FROM (VALUES {values(fixed.CALL_PRICES)}) AS t(model_id, prompt_price, completion_price)",
    "v_registry": (
        f"SELECT * FROM (VALUES {values(fixed.MODEL_REGISTRY)}) AS"
        " t(model_id, provider, prompt_price, completion_price, max_context)"
    ),
    "v_keys": (
        "SELECT o_orderkey AS key_id, o_custkey AS user_id, o_orderstatus <> 'P' AS is_active, o_orderdate AS created_at"
        " FROM orders"
    ),
    "v_webhooks": (
        "SELECT o_orderkey AS webhook_id, o_custkey AS user_id, o_orderstatus <> 'P' AS is_active,"
        " CASE o_orderkey % 3 WHEN 0 THEN '[\"session.created\"]' WHEN 1 THEN"
        " '[\"session.created\",\"shift.completed\"]' ELSE '[]' END AS events, o_orderdate AS created_at FROM orders"
    ),
    "v_trials": (
        "SELECT o_custkey AS user_id, max(o_orderdate) AS started_at, max(o_orderdate) + INTERVAL 7 DAY AS expires_at"
        " FROM orders GROUP BY o_custkey"
    ),
    "v_share_requests": (
        "SELECT o_orderkey AS request_id, o_orderkey AS session_id, o_custkey % 25 AS team_id,"
        " CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 25 END AS user_id FROM orders"
    ),
    "v_costed": (
        "SELECT c.*, c.prompt_tokens / 1e6 * coalesce(p.prompt_price, 0.0) + c.completion_tokens / 1e6 *"
        " coalesce(p.completion_price, 0.0) AS cost FROM v_calls c LEFT JOIN v_prices p USING (model_id)"
    ),
    "v_distribution": (
        "SELECT user_id, source_llm AS model, 'source' AS direction, count(*) AS count FROM v_shifts GROUP BY 1, 2"
        " UNION ALL SELECT user_id, target_llm, 'target', count(*) FROM v_shifts GROUP BY 1, 2"
        " UNION ALL SELECT user_id, source_llm, 'capture', count(*) FROM v_sessions WHERE deleted_at IS NULL"
        " GROUP BY 1, 2"
    ),
    "v_snapshot": (
        "SELECT user_id, "
        + ", ".join(
            f"CAST(coalesce(sum(amount) FILTER (WHERE metric = '{m}' AND strftime(ts, '%Y-%m') = '{PERIOD}'), 0) AS"
            f" BIGINT) AS {m}"
            for m in R.MONTHLY_METRICS
        )
        + ", CAST(coalesce(sum(amount) FILTER (WHERE metric = 'consensus_trials'), 0) AS BIGINT) AS consensus_trials"
        " FROM v_usage_events GROUP BY user_id"
    ),
}


def local(spark, sf_dir, name):
    """The local views on the Spark side."""
    from threadloom.sources.testviews import table

    orders = table(spark, sf_dir, "orders")
    if name == "v_keys":
        return orders.selectExpr(
            "o_orderkey AS key_id", "o_custkey AS user_id", "o_orderstatus <> 'P' AS is_active",
            "o_orderdate AS created_at",
        )
    if name == "v_webhooks":
        return orders.selectExpr(
            "o_orderkey AS webhook_id", "o_custkey AS user_id", "o_orderstatus <> 'P' AS is_active",
            "CASE o_orderkey % 3 WHEN 0 THEN '[\"session.created\"]' WHEN 1 THEN"
            " '[\"session.created\",\"shift.completed\"]' ELSE '[]' END AS events",
            "o_orderdate AS created_at",
        )
    if name == "v_trials":
        return (
            orders.groupBy(F.col("o_custkey").alias("user_id"))
            .agg(F.max("o_orderdate").alias("started_at"))
            .withColumn("expires_at", F.expr("started_at + INTERVAL 7 DAYS"))
        )
    if name == "v_share_requests":
        return orders.selectExpr(
            "o_orderkey AS request_id", "o_orderkey AS session_id", "o_custkey % 25 AS team_id",
            "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 25 END AS user_id",
        )
    raise KeyError(name)


@query(
    "daily_usage", "A1",
    f"""
WITH cal AS (SELECT user_id, unnest(generate_series(CAST('{NOW}' AS DATE) - INTERVAL 29 DAY, CAST('{NOW}' AS DATE),
    INTERVAL 1 DAY)) AS d FROM v_users),
sh AS (SELECT user_id, CAST(created_at AS DATE) AS d, count(*) AS shifts, sum(source_tokens + target_tokens) AS tokens
    FROM v_shifts WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1, 2),
se AS (SELECT user_id, CAST(created_at AS DATE) AS d, count(*) AS sessions FROM v_sessions
    WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND deleted_at IS NULL GROUP BY 1, 2)
SELECT cal.user_id, strftime(cal.d, '%Y-%m-%d') AS date, coalesce(shifts, 0) AS shifts,
    coalesce(sessions, 0) AS sessions, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens
FROM cal LEFT JOIN sh ON sh.user_id = cal.user_id AND sh.d = cal.d
LEFT JOIN se ON se.user_id = cal.user_id AND se.d = cal.d
""",
)
def daily_usage(spark, sf_dir):
    v = lambda n: load(spark, sf_dir, n)
    return R.daily_usage(v("v_users"), v("v_shifts"), v("v_sessions"), NOW, 30)


@query("model_distribution", "A2", "SELECT user_id, model, direction, count FROM v_distribution", LOCAL)
def model_distribution(spark, sf_dir):
    return R.model_distribution(load(spark, sf_dir, "v_shifts"), load(spark, sf_dir, "v_sessions"))


@query(
    "top_models", "A3",
    """
SELECT * FROM (SELECT user_id, model, CAST(sum(count) AS BIGINT) AS count, CAST(row_number() OVER (PARTITION BY user_id
    ORDER BY sum(count) DESC, model) AS INT) AS rank FROM v_distribution GROUP BY 1, 2) WHERE rank <= 8
""",
    LOCAL,
)
def top_models(spark, sf_dir):
    return R.top_models(model_distribution(spark, sf_dir))


@query(
    "account_summary", "A4",
    """
WITH s AS (SELECT user_id, count(*) AS total_sessions, count_if(NOT is_archived) AS active_sessions FROM v_sessions
    WHERE deleted_at IS NULL GROUP BY 1),
h AS (SELECT user_id, count(*) AS total_shifts, sum(source_tokens + target_tokens) AS total_tokens,
    count_if(strftime(created_at, '%Y-%m') = '1998-01') AS shifts_this_month FROM v_shifts GROUP BY 1)
SELECT u.user_id, tier AS subscription_tier, coalesce(total_sessions, 0) AS total_sessions,
    CAST(coalesce(active_sessions, 0) AS BIGINT) AS active_sessions, coalesce(total_shifts, 0) AS total_shifts,
    CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens,
    CAST(coalesce(shifts_this_month, 0) AS BIGINT) AS shifts_this_month
FROM v_users u LEFT JOIN s USING (user_id) LEFT JOIN h USING (user_id)
""",
)
def account_summary(spark, sf_dir):
    v = lambda n: load(spark, sf_dir, n)
    return R.account_summary(v("v_users"), v("v_shifts"), v("v_sessions"), "1998-01")


@query(
    "memory_stats", "A5",
    """
WITH s AS (SELECT user_id, count(*) AS total_sessions, count_if(is_archived) AS archived_sessions,
    sum(message_count) AS total_messages, sum(total_tokens) AS total_tokens FROM v_sessions GROUP BY 1),
c AS (SELECT s.user_id, count(*) AS total_contexts FROM v_contexts x JOIN v_sessions s USING (session_id) GROUP BY 1)
SELECT u.user_id, coalesce(total_sessions, 0) AS total_sessions,
    CAST(coalesce(archived_sessions, 0) AS BIGINT) AS archived_sessions,
    CAST(coalesce(total_messages, 0) AS BIGINT) AS total_messages,
    CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens, coalesce(total_contexts, 0) AS total_contexts,
    CAST(coalesce(total_sessions, 0) - coalesce(archived_sessions, 0) AS BIGINT) AS active_sessions
FROM v_users u LEFT JOIN s USING (user_id) LEFT JOIN c USING (user_id)
""",
)
def memory_stats(spark, sf_dir):
    v = lambda n: load(spark, sf_dir, n)
    return R.memory_stats(v("v_users"), v("v_sessions"), v("v_contexts"))


@query(
    "session_listing", "A6",
    """
SELECT user_id, session_id, source_llm, position, total FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, session_id DESC) AS INT) AS
    position, count(*) OVER (PARTITION BY user_id) AS total FROM v_sessions WHERE deleted_at IS NULL AND NOT is_archived)
WHERE position > 2 AND position <= 7
""",
)
def session_listing(spark, sf_dir):
    out = R.list_sessions(load(spark, sf_dir, "v_sessions"), 2, 5, archived=False)
    return out.select("user_id", "session_id", "source_llm", "position", "total")


@query(
    "user_teams", "A7",
    """
SELECT m.user_id, CAST(m.team_id AS BIGINT) AS team_id, t.name, m.role FROM v_team_members m JOIN v_teams t
USING (team_id) WHERE t.is_active
""",
)
def user_teams(spark, sf_dir):
    out = R.user_teams(load(spark, sf_dir, "v_teams"), load(spark, sf_dir, "v_team_members"))
    return out.withColumn("team_id", F.col("team_id").cast("bigint"))


@query(
    "team_access_check", "A8",
    """
SELECT request_id FROM v_share_requests r WHERE EXISTS (SELECT 1 FROM v_team_members m JOIN v_teams t USING (team_id)
WHERE t.is_active AND m.team_id = r.team_id AND m.user_id = r.user_id)
""",
    LOCAL,
)
def team_access_check(spark, sf_dir):
    requests = local(spark, sf_dir, "v_share_requests")
    return R.accessible(requests, load(spark, sf_dir, "v_teams"), load(spark, sf_dir, "v_team_members")).select(
        "request_id"
    )


@query(
    "team_members", "A9",
    "SELECT CAST(team_id AS BIGINT) AS team_id, user_id, role, tier FROM v_team_members JOIN v_users USING (user_id)",
)
def team_members(spark, sf_dir):
    out = R.team_members(load(spark, sf_dir, "v_team_members"), load(spark, sf_dir, "v_users"))
    return out.withColumn("team_id", F.col("team_id").cast("bigint"))


@query(
    "team_member_counts", "A10",
    "SELECT CAST(team_id AS BIGINT) AS team_id, count(*) AS member_count FROM v_team_members GROUP BY 1",
)
def team_member_counts(spark, sf_dir):
    return R.member_counts(load(spark, sf_dir, "v_team_members")).withColumn("team_id", F.col("team_id").cast("bigint"))


@query(
    "team_sessions", "A11",
    """
SELECT team_id, session_id, user_id, position, total FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY team_id ORDER BY created_at DESC, session_id DESC) AS INT) AS
    position, count(*) OVER (PARTITION BY team_id) AS total FROM v_sessions
    WHERE deleted_at IS NULL AND team_id IN (SELECT team_id FROM v_team_members))
WHERE position <= 20
""",
)
def team_sessions(spark, sf_dir):
    out = R.team_sessions(load(spark, sf_dir, "v_sessions"), load(spark, sf_dir, "v_team_members"), 0, 20)
    return out.select("team_id", "session_id", "user_id", "position", "total")


@query(
    "share_decisions", "A12",
    """
SELECT r.request_id,
    CASE WHEN s.user_id IS NULL OR s.user_id <> r.user_id THEN 'not_found' WHEN t.role IS NULL THEN 'not_a_member'
    WHEN t.role = 'viewer' THEN 'viewer' ELSE 'allowed' END AS share,
    CASE WHEN s.user_id IS NULL THEN 'not_found' WHEN s.user_id = r.user_id THEN 'allowed'
    WHEN c.role IN ('owner', 'admin') THEN 'allowed' ELSE 'forbidden' END AS revoke
FROM v_share_requests r
LEFT JOIN (SELECT * FROM v_sessions WHERE deleted_at IS NULL) s ON s.session_id = r.session_id
LEFT JOIN v_team_members t ON t.team_id = r.team_id AND t.user_id = r.user_id
LEFT JOIN v_team_members c ON c.team_id = s.team_id AND c.user_id = r.user_id
""",
    LOCAL,
)
def share_decisions(spark, sf_dir):
    return R.share_decisions(
        local(spark, sf_dir, "v_share_requests"), load(spark, sf_dir, "v_sessions"),
        load(spark, sf_dir, "v_team_members"),
    )


@query(
    "audit_by_user", "A13",
    """
SELECT user_id, id, action, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at
DESC, id DESC) AS INT) AS position FROM v_audit WHERE action = 'click') WHERE position <= 50
""",
)
def audit_by_user(spark, sf_dir):
    out = R.audit_by_user(load(spark, sf_dir, "v_audit"), 50, "click")
    return out.select("user_id", "id", "action", "position")


@query(
    "audit_by_resource", "A14",
    """
SELECT resource_type, resource_id, id, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY resource_type,
resource_id ORDER BY created_at DESC, id DESC) AS INT) AS position FROM v_audit) WHERE position <= 50
""",
)
def audit_by_resource(spark, sf_dir):
    out = R.audit_by_resource(load(spark, sf_dir, "v_audit"), 50)
    return out.select("resource_type", "resource_id", "id", "position")


@query(
    "audit_action_counts", "A15",
    """
SELECT user_id, action, CAST(count_if(created_at >= TIMESTAMP '2024-01-15 00:00:00') AS BIGINT) AS count FROM v_audit
GROUP BY 1, 2
""",
)
def audit_action_counts(spark, sf_dir):
    return R.action_counts(load(spark, sf_dir, "v_audit"), "2024-01-15 00:00:00")


@query(
    "key_listing", "A16",
    """
SELECT user_id, key_id, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC,
key_id DESC) AS INT) AS position FROM v_keys WHERE is_active) WHERE position <= 100
""",
    LOCAL,
)
def key_listing(spark, sf_dir):
    from threadloom.functions import ordered

    active = local(spark, sf_dir, "v_keys").where("is_active")
    out = ordered.top_rows(active, ["user_id"], [F.desc("created_at"), F.desc("key_id")], 100, "position")
    return out.select("user_id", "key_id", "position")


@query(
    "webhook_listing", "A16",
    """
SELECT user_id, webhook_id, events, is_active, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, webhook_id DESC) AS
    position FROM v_webhooks
""",
    LOCAL,
)
def webhook_listing(spark, sf_dir):
    return R.listing(local(spark, sf_dir, "v_webhooks"), "webhook_id").select(
        "user_id", "webhook_id", "events", "is_active", "position"
    )


@query(
    "event_subscribers", "A17",
    """
SELECT DISTINCT e.event, webhook_id, user_id FROM v_webhooks, (VALUES ('session.created'), ('shift.completed')) e(event)
WHERE is_active AND contains(events, '"' || e.event || '"')
""",
    LOCAL,
)
def event_subscribers(spark, sf_dir):
    return R.event_subscribers(local(spark, sf_dir, "v_webhooks"))


@query("usage_snapshot", "A18", "SELECT * FROM v_snapshot", LOCAL)
def usage_snapshot(spark, sf_dir):
    return R.usage_snapshot(load(spark, sf_dir, "v_usage_events"), PERIOD)


METRICS = "'shifts', 'brain_queries', 'tokens_processed', 'auto_captures', 'consensus_trials'"
LOCAL["v_usage_report"] = (
    "SELECT u.user_id, u.tier, display_name, m.metric, CAST(coalesce(s.current, 0) AS BIGINT) AS current,"
    " CAST(m.limit_value AS BIGINT) AS limit_value FROM v_users u JOIN (UNPIVOT (SELECT tier, display_name,"
    " CAST(shifts AS BIGINT) AS shifts, CAST(brain_queries AS BIGINT) AS brain_queries,"
    " CAST(tokens_processed AS BIGINT) AS tokens_processed, CAST(auto_captures AS BIGINT) AS auto_captures,"
    " CAST(consensus_trials AS BIGINT) AS consensus_trials FROM v_tiers) ON shifts, brain_queries, tokens_processed,"
    " auto_captures, consensus_trials INTO NAME metric VALUE limit_value) m ON m.tier = u.tier"
    " LEFT JOIN (UNPIVOT v_snapshot ON shifts, brain_queries, tokens_processed, auto_captures, consensus_trials"
    " INTO NAME metric VALUE current) s ON s.user_id = u.user_id AND s.metric = m.metric"
)


@query(
    "usage_limit_check", "A19",
    """
SELECT user_id, metric, current, limit_value, (limit_value = -1 OR current < limit_value) AS allowed,
    CASE WHEN limit_value = -1 THEN metric || ': unlimited'
    WHEN current < limit_value THEN metric || ': ' || current || '/' || limit_value || ' used, ' ||
        (limit_value - current) || ' remaining'
    ELSE metric || ': limit reached (' || current || '/' || limit_value || '). Upgrade your plan for more.' END AS message
FROM v_usage_report
""",
    LOCAL,
)
def usage_limit_check(spark, sf_dir):
    v = lambda n: load(spark, sf_dir, n)
    report = R.usage_report(v("v_users"), v("v_usage_events"), dims.tiers(spark), PERIOD)
    message = R.limit_message(F.col("metric"), F.col("current"), F.col("limit_value"))
    return report.select("user_id", "metric", "current", "limit_value", "allowed", message.alias("message"))


@query(
    "usage_report", "A20",
    """
SELECT user_id, tier, display_name, metric, current, limit_value, CASE WHEN limit_value = -1 THEN -1 ELSE
    greatest(0, limit_value - current) END AS remaining, (limit_value = -1 OR current < limit_value) AS allowed,
    limit_value = -1 AS is_unlimited FROM v_usage_report
""",
    LOCAL,
)
def usage_report(spark, sf_dir):
    v = lambda n: load(spark, sf_dir, n)
    return R.usage_report(v("v_users"), v("v_usage_events"), dims.tiers(spark), PERIOD)


@query(
    "tier_quota_use", "A21",
    """
SELECT tier, metric, count(*) AS users, CAST(sum(current) AS BIGINT) AS used,
    CAST(count_if(limit_value <> -1 AND current >= limit_value) AS BIGINT) AS over_limit,
    min(CASE WHEN limit_value = -1 THEN -1 ELSE greatest(0, limit_value - current) END) AS least_remaining
FROM v_usage_report GROUP BY 1, 2
""",
    LOCAL,
)
def tier_quota_use(spark, sf_dir):
    return (
        usage_report(spark, sf_dir)
        .groupBy("tier", "metric")
        .agg(
            F.count("*").alias("users"),
            F.sum("current").alias("used"),
            F.count_if(~F.col("allowed")).alias("over_limit"),
            F.min("remaining").alias("least_remaining"),
        )
    )


FEATURES = ", ".join(fixed.TIER_FEATURES)


@query(
    "feature_gate", "A22",
    f"""
WITH f AS (UNPIVOT (SELECT tier, display_name, tier_rank, {FEATURES} FROM v_tiers) ON {FEATURES} INTO NAME feature
    VALUE enabled),
r AS (SELECT feature, arg_min(display_name, tier_rank) AS required FROM f WHERE enabled AND tier IN ('pro', 'pro_team')
    GROUP BY 1)
SELECT u.user_id, u.tier, f.feature, f.enabled, CASE WHEN NOT f.enabled THEN coalesce(r.required, 'Pro') END AS
    required_tier
FROM v_users u JOIN f USING (tier) LEFT JOIN r USING (feature)
""",
    LOCAL,
)
def feature_gate(spark, sf_dir):
    return R.feature_gate(load(spark, sf_dir, "v_users"), dims.tiers(spark))


@query(
    "effective_tier", "A23",
    """
SELECT user_id, tier, CASE WHEN tier = 'free' AND coalesce(expires_at > TIMESTAMP '1998-08-01 00:00:00', FALSE) THEN
    'pro' ELSE tier END AS effective_tier, coalesce(expires_at > TIMESTAMP '1998-08-01 00:00:00', FALSE) AS trial_active,
    expires_at IS NOT NULL AS trial_offered,
    round(greatest(0.0, coalesce(date_diff('second', TIMESTAMP '1998-08-01 00:00:00', expires_at) / 86400.0, 0.0)), 2)
    AS days_remaining
FROM v_users LEFT JOIN v_trials USING (user_id)
""",
    LOCAL,
)
def effective_tier(spark, sf_dir):
    return R.effective_tier(
        load(spark, sf_dir, "v_users"), local(spark, sf_dir, "v_trials").drop("started_at"), "1998-08-01 00:00:00"
    )


@query(
    "trial_counts", "A24",
    """
SELECT CAST(count_if(expires_at > TIMESTAMP '1998-08-01 00:00:00') AS BIGINT) AS active_trials,
    CAST(count_if(expires_at <= TIMESTAMP '1998-08-01 00:00:00') AS BIGINT) AS expired_trials FROM v_trials
""",
    LOCAL,
)
def trial_counts(spark, sf_dir):
    return R.trial_counts(local(spark, sf_dir, "v_trials"), "1998-08-01 00:00:00")


@query("call_cost", "A25", "SELECT call_id, session_id, model_id, round(cost, 8) AS cost FROM v_costed", LOCAL)
def call_cost(spark, sf_dir):
    out = R.call_cost(load(spark, sf_dir, "v_calls"), dims.call_prices(spark))
    return out.select("call_id", "session_id", "model_id", F.round("cost", 8).alias("cost"))


@query(
    "session_costs", "A26",
    """
SELECT session_id, model_id, round(sum(cost), 9) AS model_cost, CAST(sum(count(*)) OVER (PARTITION BY session_id) AS
    BIGINT) AS calls, CAST(sum(sum(prompt_tokens)) OVER (PARTITION BY session_id) AS BIGINT) AS prompt_tokens,
    CAST(sum(sum(completion_tokens)) OVER (PARTITION BY session_id) AS BIGINT) AS completion_tokens,
    round(sum(sum(cost)) OVER (PARTITION BY session_id), 9) AS session_cost
FROM v_costed GROUP BY session_id, model_id
""",
    LOCAL,
)
def session_costs(spark, sf_dir):
    costed = R.call_cost(load(spark, sf_dir, "v_calls"), dims.call_prices(spark))
    return R.session_costs(costed).select(
        "session_id",
        "calls",
        "prompt_tokens",
        "completion_tokens",
        F.round("cost", 9).alias("session_cost"),
        F.explode("cost_by_model").alias("model_id", "model_cost"),
    ).withColumn("model_cost", F.round("model_cost", 9))


@query(
    "price_override", "A27",
    """
WITH p AS (SELECT model_id, prompt_price, completion_price FROM v_prices WHERE model_id <> 'openai/gpt-4o'
    UNION ALL SELECT * FROM (VALUES ('openai/gpt-4o', 9.0, 19.0), ('unknown/model', 1.0, 2.0)) t)
SELECT c.model_id, count(*) AS calls, round(sum(c.prompt_tokens / 1e6 * coalesce(p.prompt_price, 0.0) +
    c.completion_tokens / 1e6 * coalesce(p.completion_price, 0.0)), 9) AS cost
FROM v_calls c LEFT JOIN p USING (model_id) GROUP BY 1
""",
    LOCAL,
)
def price_override(spark, sf_dir):
    custom = spark.createDataFrame(
        [("openai/gpt-4o", 9.0, 19.0), ("unknown/model", 1.0, 2.0)],
        "model_id string, prompt_price double, completion_price double",
    )
    prices = R.override_prices(dims.call_prices(spark), custom)
    costed = R.call_cost(load(spark, sf_dir, "v_calls"), prices)
    return costed.groupBy("model_id").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 9).alias("cost"))


@query(
    "registry_cost", "A28",
    """
SELECT call_id, r.provider, round(c.prompt_tokens / 1e6 * coalesce(prompt_price, 0.0) + c.completion_tokens / 1e6 *
    coalesce(completion_price, 0.0), 9) AS cost
FROM (SELECT *, string_split(model_id, '/')[2] AS short_id FROM v_calls) c
LEFT JOIN v_registry r ON r.model_id = c.short_id
""",
    LOCAL,
)
def registry_cost(spark, sf_dir):
    calls = load(spark, sf_dir, "v_calls").withColumn("model_id", F.element_at(F.split("model_id", "/"), 2))
    return R.call_cost(calls, dims.model_registry(spark), 9).select("call_id", "provider", "cost")


@query(
    "run_totals", "A34",
    """
SELECT session_id, count(*) AS steps,
    CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (WHERE call_id % 11 <> 0), 0) AS BIGINT) AS total_tokens,
    round(coalesce(sum(cost) FILTER (WHERE call_id % 11 <> 0), 0.0), 9) AS total_cost,
    bool_or(call_id % 11 = 0) AS has_error, arg_max(CAST(call_id AS VARCHAR), call_id) AS last_output
FROM v_costed GROUP BY session_id
""",
    LOCAL,
)
def run_totals(spark, sf_dir):
    costed = R.call_cost(load(spark, sf_dir, "v_calls"), dims.call_prices(spark)).withColumns(
        {
            "error": F.col("call_id") % 11 == 0,
            "output": F.col("call_id").cast("string"),
            "step": F.col("call_id"),
        }
    )
    return R.run_totals(costed).withColumn("total_cost", F.round("total_cost", 9))


@query(
    "running_costs", "A35",
    """
SELECT call_id, session_id, model_id, CAST(sum(prompt_tokens + completion_tokens) OVER w AS BIGINT) AS running_tokens,
    round(sum(cost) OVER w, 9) AS running_cost
FROM v_costed WINDOW w AS (PARTITION BY session_id, model_id ORDER BY call_id ROWS UNBOUNDED PRECEDING)
""",
    LOCAL,
)
def running_costs(spark, sf_dir):
    costed = R.call_cost(load(spark, sf_dir, "v_calls"), dims.call_prices(spark))
    return R.running_costs(costed).select(
        "call_id", "session_id", "model_id", "running_tokens", F.round("running_cost", 9).alias("running_cost")
    )
