"""Registered streaming queries: every job runs as a stream over the whole table and its batch form runs next to it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from threadloom.functions import dims
from threadloom.functions import text as T
from threadloom.plans.registry import query
from threadloom.plans.reports import LOCAL
from threadloom.plans.safety import FLAGS_SQL, PLANT_SQL, UNSAFE
from threadloom.plans.safety import VIEWS as PLANTED_VIEWS
from threadloom.plans.summaries import sql_strip
from threadloom.sources.testviews import load, table
from threadloom.streaming import jobs as J

VIEWS = {
    **LOCAL,
    # Events as captures: one conversation per user, the message count moves now and then.
    "v_captures": (
        "SELECT user_id AS conversation_id, event_id AS capture_id, ts AS captured_at, CAST(floor(value) AS BIGINT) % 3 AS"
        " message_count FROM events"
    ),
    "v_runs": (
        "SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY webhook_id ORDER BY ts, event_id ROWS UNBOUNDED"
        " PRECEDING) AS run FROM v_hooks"
    ),
    # Enough failures in a row for some hooks to be switched off.
    "v_hooks": (
        "SELECT user_id AS webhook_id, ts, event_id, NOT (event_type IN ('error', 'view', 'click') OR user_id % 3 = 0) AS"
        " success FROM events"
    ),
    "v_health": (
        "SELECT webhook_id, event_id, CAST(failures AS BIGINT) AS failure_count, max(failures) OVER (PARTITION BY webhook_id"
        " ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) < 10 AS is_active FROM (SELECT *, sum(CASE WHEN success THEN 0 ELSE"
        " 1 END) OVER (PARTITION BY webhook_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM v_runs)"
    ),
}


def stream_of(spark, sf_dir, name):
    """A stream over a whole table, which is one file of the folder or a folder of files itself."""
    rows = table(spark, sf_dir, name)
    if any(f.endswith(f"/{name}.parquet") for f in rows.inputFiles()):
        return J.read_stream(spark, sf_dir, f"{name}.parquet", rows.schema)
    return J.read_stream(spark, f"{sf_dir}/{name}.parquet", "*", rows.schema)


def with_zone(df, *columns):
    """Event times as timestamps (the files store them without zone, in UTC)."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def captures(events):
    return with_zone(
        events.selectExpr(
            "user_id AS conversation_id", "event_id AS capture_id", "ts AS captured_at",
            "CAST(floor(value) AS BIGINT) % 3 AS message_count",
        ),
        "captured_at",
    )


NEWEST = """
SELECT conversation_id, capture_id, message_count FROM v_captures QUALIFY row_number() OVER (PARTITION BY conversation_id
    ORDER BY captured_at DESC, capture_id DESC) = 1
"""
CHANGED = """
SELECT conversation_id, capture_id, message_count FROM (SELECT *, lag(message_count) OVER (PARTITION BY conversation_id ORDER
    BY captured_at, capture_id) AS before FROM v_captures) WHERE before IS NULL OR before <> message_count
"""


@query("newest_captures", "X1", NEWEST, VIEWS)
def newest_captures(spark, sf_dir):
    return J.newest(captures(table(spark, sf_dir, "events"))).drop("captured_at")


@query("stream_newest_captures", "X1", NEWEST, VIEWS)
def stream_newest_captures(spark, sf_dir):
    return J.stream_newest(captures(stream_of(spark, sf_dir, "events")), J.fresh(spark, "newest")).drop("captured_at")


@query("changed_captures", "X2", CHANGED, VIEWS)
def changed_captures(spark, sf_dir):
    return J.changed_counts(captures(table(spark, sf_dir, "events"))).drop("captured_at")


@query("stream_changed_captures", "X2", CHANGED, VIEWS)
def stream_changed_captures(spark, sf_dir):
    out = J.stream_changed_counts(captures(stream_of(spark, sf_dir, "events")), J.fresh(spark, "changed"))
    return out.drop("captured_at")


def identified(events):
    """Every event as a message; events of a user with the same type and props are copies."""
    return with_zone(
        events.select(
            T.message_identity(F.col("event_type"), F.col("user_id"), F.col("props")).alias("identity"), "ts", "event_id"
        ),
        "ts",
    )


@query(
    "stream_distinct_messages", "X3",
    "SELECT DISTINCT sha256(event_type || ':' || user_id || ':' || substr(props, 1, 200)) AS identity FROM events",
)
def stream_distinct_messages(spark, sf_dir):
    messages = identified(stream_of(spark, sf_dir, "events"))
    return J.stream_distinct_messages(messages, J.fresh(spark, "distinct"), "400 days").select("identity")


METERED = """
SELECT user_id, CASE WHEN metric = 'consensus_trials' THEN 'lifetime' ELSE strftime(ts, '%Y-%m') END AS period, metric,
    CAST(sum(amount) AS BIGINT) AS count FROM v_usage_events GROUP BY ALL
"""


@query("usage_metering", "X4", METERED)
def usage_metering(spark, sf_dir):
    return J.metered(load(spark, sf_dir, "v_usage_events"))


@query("stream_usage_metering", "X4", METERED)
def stream_usage_metering(spark, sf_dir):
    usage = stream_of(spark, sf_dir, "events").selectExpr(
        "user_id", "ts",
        "CASE event_type WHEN 'purchase' THEN 'shifts' WHEN 'view' THEN 'brain_queries' WHEN 'click' THEN 'auto_captures'"
        " WHEN 'signup' THEN 'consensus_trials' ELSE 'tokens_processed' END AS metric",
        "CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) ELSE 1L END AS amount",
    )
    return J.stream_metered(usage, J.fresh(spark, "metered"))


def requests(spark, events, peek=None):
    """Requests of all users on two plans; time runs 600 times as fast, so that limits are reached."""
    plans = dims.tiers(spark).where(F.col("tier").isin("free", "enterprise")).select("tier", "requests_per_hour", "burst_size")
    tier = F.when(F.col("user_id") % 10 == 0, "enterprise").otherwise("free")
    base = F.timestamp_micros(F.expr("unix_micros(CAST(ts AS TIMESTAMP)) div 600"))
    flag = F.lit(False) if peek is None else peek
    rows = events.select("user_id", F.col("event_id").alias("request_id"), base.alias("ts"), tier.alias("tier"), flag.alias("peek"))
    return rows.join(F.broadcast(plans), "tier").drop("tier")


def limiter_sql(peek="FALSE"):
    """The bucket of each user, request by request."""
    return f"""
WITH RECURSIVE asked AS (SELECT user_id, event_id AS request_id, (epoch_us(ts) // 600) / 1e6 AS s, requests_per_hour AS rph,
    requests_per_hour + burst_size AS cap, {peek} AS peek, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 600, event_id) AS
    nth FROM events JOIN v_tiers ON tier = CASE WHEN user_id % 10 = 0 THEN 'enterprise' ELSE 'free' END),
bucket(user_id, request_id, nth, last, rph, cap, had, peek) AS (SELECT user_id, request_id, nth, s, rph, cap, CAST(cap AS DOUBLE), peek FROM
    asked WHERE nth = 1 UNION ALL SELECT a.user_id, a.request_id, a.nth, a.s, a.rph, a.cap, least(CAST(a.cap AS DOUBLE), had - CASE WHEN had
    >= 1 AND NOT b.peek THEN 1 ELSE 0 END + (a.s - b.last) * (CAST(a.rph AS DOUBLE) / 3600e0)), a.peek FROM bucket b JOIN asked a ON
    a.user_id = b.user_id AND a.nth = b.nth + 1)
SELECT user_id, request_id, rph = -1 OR had >= 1 AS allowed, CAST(CASE WHEN rph = -1 THEN -1 WHEN had < 1 THEN 0 ELSE floor(had - CASE WHEN
    peek THEN 0 ELSE 1 END) END AS BIGINT) AS remaining, CAST(CASE WHEN rph = -1 THEN -1 ELSE cap END AS BIGINT) AS "limit", CASE WHEN rph = -1
    OR had >= 1 THEN 0.0 ELSE round((1 - had) / (CAST(rph AS DOUBLE) / 3600e0), 3) END AS reset_in_seconds, CASE WHEN rph = -1
    OR had >= 1 THEN 0.0 ELSE round((1 - had) / (CAST(rph AS DOUBLE) / 3600e0), 3) END AS retry_after FROM bucket
"""


def rounded(verdicts):
    return verdicts.withColumns({c: F.round(c, 3) for c in ("reset_in_seconds", "retry_after")})


@query("rate_limiter", "X5", limiter_sql(), VIEWS)
def rate_limiter(spark, sf_dir):
    return rounded(J.limited(requests(spark, table(spark, sf_dir, "events"))))


@query("rate_limiter_peeks", "X5", limiter_sql("event_type = 'error'"), VIEWS)
def rate_limiter_peeks(spark, sf_dir):
    """Error events only look at their bucket."""
    return rounded(J.limited(requests(spark, table(spark, sf_dir, "events"), F.col("event_type") == "error")))


@query("stream_rate_limiter", "X5", limiter_sql(), VIEWS)
def stream_rate_limiter(spark, sf_dir):
    return rounded(J.stream_limited(requests(spark, stream_of(spark, sf_dir, "events")), J.fresh(spark, "limited")))


def hooks(events):
    return with_zone(
        events.selectExpr(
            "user_id AS webhook_id", "ts", "event_id",
            "NOT (event_type IN ('error', 'view', 'click') OR user_id % 3 = 0) AS success",
        ),
        "ts",
    )


@query("delivery_health", "X6", "SELECT * FROM v_health", VIEWS)
def delivery_health(spark, sf_dir):
    return J.delivery_health(hooks(table(spark, sf_dir, "events")))


@query("stream_delivery_health", "X6", "SELECT * FROM v_health", VIEWS)
def stream_delivery_health(spark, sf_dir):
    return J.stream_delivery_health(hooks(stream_of(spark, sf_dir, "events")), J.fresh(spark, "health"))


def beats(events):
    rows = events.selectExpr("user_id % 10 AS connection_id", "event_id", "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) div 40) AS ts")
    return rows


BEATS = "SELECT user_id % 10 AS connection_id, event_id, epoch_us(ts) // 40 AS us FROM events"


DROPPED = f"""
SELECT connection_id, us AS last_seen FROM (SELECT *, lead(us) OVER (PARTITION BY connection_id ORDER BY us, event_id) AS later
    FROM ({BEATS})) WHERE later IS NULL OR later - us > 120000000
"""


@query("dropped_connections", "X7", DROPPED)
def dropped_connections(spark, sf_dir):
    out = J.dropped_connections(beats(table(spark, sf_dir, "events")))
    return out.withColumn("last_seen", F.unix_micros("last_seen"))


@query("stream_connections", "X7", DROPPED)
def stream_connections(spark, sf_dir):
    """All sessions of all connections: after the last beat the clock moves on by the limit and the delay."""
    last = beats(table(spark, sf_dir, "events")).agg(F.max("ts").alias("ts")).first().ts
    now = last + timedelta(seconds=J.STALE_SECONDS + 60)
    stream = beats(stream_of(spark, sf_dir, "events"))
    out = J.stream_connections(stream, J.fresh(spark, "connections"), "10 seconds", now)
    return out.select("connection_id", F.unix_micros("last_seen").alias("last_seen"))


@query(
    "stream_sanitized", "X8",
    f"""
SELECT conv_id, turn, NOT ({UNSAFE}) AS is_safe, CAST(coalesce(n, 0) AS INT) AS injection_count FROM v_planted LEFT JOIN (SELECT conv_id, turn,
    count(*) AS n FROM ({FLAGS_SQL}) GROUP BY ALL) USING (conv_id, turn)
""",
    PLANTED_VIEWS,
)
def stream_sanitized(spark, sf_dir):
    """The conversations with planted attacks and secrets, sanitized on arrival."""
    messages = stream_of(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text AS full_text")
    messages = messages.withColumn("full_text", F.expr(PLANT_SQL))
    out = J.stream_sanitized(messages, J.fresh(spark, "sanitized"))
    return out.select("conv_id", "turn", "is_safe", "injection_count")


@query(
    "stream_normalized", "X8",
    f"SELECT conv_id || ':' || turn AS conv_id, CAST(0 AS INT) AS turn, 'user' AS role, {sql_strip('full_text')} AS full_text FROM v_messages",
)
def stream_normalized(spark, sf_dir):
    rows = stream_of(spark, sf_dir, "conversations")
    export = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    exports = rows.select(F.concat_ws(":", "conv_id", "turn").alias("conv_id"), export.alias("raw"))
    return J.stream_normalized(exports, J.fresh(spark, "normalized"), "openai").select("conv_id", "turn", "role", "full_text")


