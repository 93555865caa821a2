"""Usage, billing, audit, team and cost reports over the relational tables, for all users at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed, ordered

UNLIMITED = -1
MONTHLY_METRICS = ["shifts", "brain_queries", "tokens_processed", "auto_captures"]
LIFETIME_METRIC = "consensus_trials"


def daily_usage(users: DataFrame, shifts: DataFrame, sessions: DataFrame, now: str, days: int) -> DataFrame:
    """Shifts, tokens and new sessions per user and day, zero-filled over the last `days` days."""
    moment = F.lit(now).cast("timestamp_ntz")
    since = moment - F.make_dt_interval(F.lit(days))
    by_shift = (
        shifts.where(F.col("created_at") >= since)
        .groupBy("user_id", F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("shifts"), F.sum(F.col("source_tokens") + F.col("target_tokens")).alias("tokens"))
    )
    by_session = (
        sessions.where((F.col("created_at") >= since) & F.col("deleted_at").isNull())
        .groupBy("user_id", F.to_date("created_at").alias("day"))
        .agg(F.count("*").alias("sessions"))
    )
    last = F.to_date(moment)
    calendar = users.select("user_id", F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    joined = calendar.join(by_shift, ["user_id", "day"], "left").join(by_session, ["user_id", "day"], "left")
    return joined.select(
        "user_id",
        F.col("day").cast("string").alias("date"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shifts", "sessions", "tokens")],
    )


def model_distribution(shifts: DataFrame, sessions: DataFrame) -> DataFrame:
    """How often each model was a source, a target or captured."""

    def count_by(df, column, direction):
        return (
            df.groupBy("user_id", F.col(column).alias("model"))
            .agg(F.count("*").alias("count"))
            .withColumn("direction", F.lit(direction))
        )

    live = sessions.where(F.col("deleted_at").isNull())
    return (
        count_by(shifts, "source_llm", "source")
        .unionByName(count_by(shifts, "target_llm", "target"))
        .unionByName(count_by(live, "source_llm", "capture"))
    )


def top_models(distribution: DataFrame, n: int = 8) -> DataFrame:
    summed = distribution.groupBy("user_id", "model").agg(F.sum("count").alias("count"))
    return ordered.top_rows(summed, ["user_id"], [F.desc("count"), F.asc("model")], n)


def account_summary(users: DataFrame, shifts: DataFrame, sessions: DataFrame, month: str) -> DataFrame:
    live = sessions.where(F.col("deleted_at").isNull())
    s = live.groupBy("user_id").agg(
        F.count("*").alias("total_sessions"), F.count_if(~F.col("is_archived")).alias("active_sessions")
    )
    h = shifts.groupBy("user_id").agg(
        F.count("*").alias("total_shifts"),
        F.sum(F.col("source_tokens") + F.col("target_tokens")).alias("total_tokens"),
        F.count_if(F.date_format("created_at", "yyyy-MM") == month).alias("shifts_this_month"),
    )
    numbers = ["total_sessions", "active_sessions", "total_shifts", "total_tokens", "shifts_this_month"]
    joined = users.join(s, "user_id", "left").join(h, "user_id", "left")
    return joined.select(
        "user_id", F.col("tier").alias("subscription_tier"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers]
    )


def memory_stats(users: DataFrame, sessions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Session totals per user, soft-deleted rows included, and the stored contexts of those sessions."""
    s = sessions.groupBy("user_id").agg(
        F.count("*").alias("total_sessions"),
        F.count_if(F.col("is_archived")).alias("archived_sessions"),
        F.sum("message_count").alias("total_messages"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    # Counted per session first: one small row per session crosses the join instead of every stored context.
    per_session = contexts.groupBy("session_id").agg(F.count("*").alias("n"))
    c = (
        sessions.select("session_id", "user_id")
        .join(per_session, "session_id")
        .groupBy("user_id")
        .agg(F.sum("n").alias("total_contexts"))
    )
    joined = users.select("user_id").join(s, "user_id", "left").join(c, "user_id", "left")
    zero = {k: F.coalesce(F.col(k), F.lit(0)) for k in s.columns[1:] + ["total_contexts"]}
    return joined.select(
        "user_id",
        *[v.alias(k) for k, v in zero.items()],
        (zero["total_sessions"] - zero["archived_sessions"]).alias("active_sessions"),
    )


def page(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int, limit: int, total: str = "total"
) -> DataFrame:
    """One page per key plus the number of rows before paging."""
    totals = df.groupBy(*keys).agg(F.count("*").alias(total))
    rows = ordered.top_rows(df, keys, order, offset + limit, "position").where(F.col("position") > offset)
    return rows.join(totals, list(keys))


def list_sessions(
    sessions: DataFrame, offset: int, limit: int, archived: bool | None = None, provider: str | None = None
) -> DataFrame:
    live = sessions.where(F.col("deleted_at").isNull())
    if archived is not None:
        live = live.where(F.col("is_archived") == archived)
    if provider is not None:
        live = live.where(F.col("source_llm") == provider)
    return page(live, ["user_id"], [F.desc("created_at"), F.desc("session_id")], offset, limit)


def user_teams(teams: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(teams.where("is_active"), "team_id").select("user_id", "team_id", "name", "role")


def accessible(requests: DataFrame, teams: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (user_id, team_id) that name a live team the user belongs to."""
    live = members.join(teams.where("is_active"), "team_id", "left_semi")
    return requests.join(live, ["user_id", "team_id"], "left_semi")


def team_members(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users, "user_id").select("team_id", "user_id", "role", "tier")


def member_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("team_id").agg(F.count("*").alias("member_count"))


def team_sessions(sessions: DataFrame, members: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the shared live sessions of every team that has members."""
    with_members = members.select("team_id").distinct()
    shared = sessions.where(F.col("team_id").isNotNull() & F.col("deleted_at").isNull())
    shared = shared.join(with_members, "team_id", "left_semi")
    return page(shared, ["team_id"], [F.desc("created_at"), F.desc("session_id")], offset, limit)


def share_decisions(requests: DataFrame, sessions: DataFrame, members: DataFrame) -> DataFrame:
    """May `user_id` share `session_id` with `team_id`?  May they revoke an existing share?"""
    live = sessions.where(F.col("deleted_at").isNull()).select(
        "session_id", F.col("user_id").alias("owner_id"), F.col("team_id").alias("shared_team_id")
    )
    target = members.select("team_id", "user_id", F.col("role").alias("target_role"))
    current = members.select(
        F.col("team_id").alias("shared_team_id"), "user_id", F.col("role").alias("shared_role")
    )
    joined = (
        requests.join(live, "session_id", "left")
        .join(target, ["team_id", "user_id"], "left")
        .join(current, ["shared_team_id", "user_id"], "left")
    )
    owns = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    found = F.col("owner_id").isNotNull()
    share = (
        F.when(~owns, "not_found")
        .when(F.col("target_role").isNull(), "not_a_member")
        .when(F.col("target_role") == "viewer", "viewer")
        .otherwise("allowed")
    )
    revoke = (
        F.when(~found, "not_found")
        .when(owns, "allowed")
        .when(F.col("shared_role").isin("owner", "admin"), "allowed")
        .otherwise("forbidden")
    )
    return joined.select("request_id", share.alias("share"), revoke.alias("revoke"))


def audit_by_user(audit: DataFrame, limit: int, action: str | None = None) -> DataFrame:
    rows = audit if action is None else audit.where(F.col("action") == action)
    return ordered.top_rows(rows, ["user_id"], [F.desc("created_at"), F.desc("id")], limit, "position")


def audit_by_resource(audit: DataFrame, limit: int) -> DataFrame:
    keys = ["resource_type", "resource_id"]
    return ordered.top_rows(audit, keys, [F.desc("created_at"), F.desc("id")], limit, "position")


def listing(rows: DataFrame, key: str) -> DataFrame:
    """All rows of each user, newest first, with their position; a user of any number of rows is cut by creation day."""
    order = [F.desc("created_at"), F.desc(key)]
    # Days count down along the order.
    day = -F.unix_date(F.col("created_at").cast("date"))
    out = ordered.running_sum(rows, ["user_id"], order, F.lit(1), day, "position")
    return out.withColumn("position", F.col("position").cast("bigint"))


def action_counts(audit: DataFrame, since: str) -> DataFrame:
    recent = F.col("created_at") >= F.lit(since).cast("timestamp_ntz")
    return audit.groupBy("user_id", "action").agg(F.count_if(recent).alias("count"))


def event_subscribers(webhooks: DataFrame) -> DataFrame:
    """Active webhooks per subscribed event; `events` is a JSON array of names."""
    names = F.from_json("events", "array<string>")
    return webhooks.where("is_active").select(F.explode(F.array_distinct(names)).alias("event"), "webhook_id", "user_id")


def usage_snapshot(usage: DataFrame, period: str) -> DataFrame:
    """Monthly metrics of the period and the lifetime metric, one column each."""
    lifetime = F.col("metric") == LIFETIME_METRIC
    in_period = F.date_format("ts", "yyyy-MM") == period
    sums = [
        F.coalesce(F.sum(F.when((F.col("metric") == m) & in_period, F.col("amount"))), F.lit(0)).alias(m)
        for m in MONTHLY_METRICS
    ]
    life = F.coalesce(F.sum(F.when(lifetime, F.col("amount"))), F.lit(0)).alias(LIFETIME_METRIC)
    return usage.groupBy("user_id").agg(*sums, life)


def usage_report(users: DataFrame, usage: DataFrame, tiers: DataFrame, period: str) -> DataFrame:
    """One row per user and metric with the tier's limit, what is left and whether the next unit is allowed."""
    metrics = [*MONTHLY_METRICS, LIFETIME_METRIC]
    stack = ", ".join(f"'{m}', {m}" for m in metrics)
    limits = tiers.selectExpr("tier", "display_name", f"stack({len(metrics)}, {stack}) AS (metric, limit_value)")
    long_form = usage_snapshot(usage, period).selectExpr(
        "user_id", f"stack({len(metrics)}, {stack}) AS (metric, current)"
    )
    joined = users.join(F.broadcast(limits), "tier").join(long_form, ["user_id", "metric"], "left")
    current = F.coalesce("current", F.lit(0).cast("bigint"))
    return joined.select(
        "user_id",
        "tier",
        "display_name",
        "metric",
        current.alias("current"),
        F.col("limit_value"),
        remaining(current, F.col("limit_value")).alias("remaining"),
        within_limit(current, F.col("limit_value")).alias("allowed"),
        (F.col("limit_value") == UNLIMITED).alias("is_unlimited"),
    )


def within_limit(current: Column, limit: Column) -> Column:
    return (limit == UNLIMITED) | (current < limit)


def remaining(current: Column, limit: Column) -> Column:
    return F.when(limit == UNLIMITED, F.lit(UNLIMITED)).otherwise(F.greatest(F.lit(0), limit - current))


def limit_message(metric: Column, current: Column, limit: Column) -> Column:
    used = F.concat(current.cast("string"), F.lit("/"), limit.cast("string"))
    return (
        F.when(limit == UNLIMITED, F.concat(metric, F.lit(": unlimited")))
        .when(
            current < limit,
            F.concat(metric, F.lit(": "), used, F.lit(" used, "), remaining(current, limit).cast("string"),
                     F.lit(" remaining")),
        )
        .otherwise(F.concat(metric, F.lit(": limit reached ("), used, F.lit("). Upgrade your plan for more.")))
    )


def feature_gate(users: DataFrame, tiers: DataFrame) -> DataFrame:
    """Every feature of every user: enabled, or the cheapest paid tier that has it."""
    stack = ", ".join(f"'{f}', {f}" for f in fixed.TIER_FEATURES)
    flags = tiers.selectExpr(
        "tier", "display_name", "tier_rank", f"stack({len(fixed.TIER_FEATURES)}, {stack}) AS (feature, enabled)"
    )
    paid = flags.where(F.col("enabled") & F.col("tier").isin("pro", "pro_team"))
    required = paid.groupBy("feature").agg(F.min_by("display_name", "tier_rank").alias("required"))
    gates = flags.join(F.broadcast(required), "feature", "left").select(
        "tier",
        "feature",
        "enabled",
        F.when(~F.col("enabled"), F.coalesce("required", F.lit("Pro"))).alias("required_tier"),
    )
    return users.join(F.broadcast(gates), "tier")


def effective_tier(users: DataFrame, trials: DataFrame, now: str, trial_tier: str = "pro") -> DataFrame:
    """A running trial lifts a free user to the trial tier; paid users keep theirs."""
    moment = F.lit(now).cast("timestamp_ntz")
    left = F.timestamp_diff("SECOND", moment, F.col("expires_at")) / F.lit(86400.0)
    active = F.coalesce(F.col("expires_at") > moment, F.lit(False))
    return users.join(trials, "user_id", "left").select(
        "user_id",
        "tier",
        F.when((F.col("tier") == "free") & active, trial_tier).otherwise(F.col("tier")).alias("effective_tier"),
        active.alias("trial_active"),
        F.col("expires_at").isNotNull().alias("trial_offered"),
        F.round(F.greatest(F.lit(0.0), F.coalesce(left, F.lit(0.0))), 2).alias("days_remaining"),
    )


def trial_counts(trials: DataFrame, now: str) -> DataFrame:
    moment = F.lit(now).cast("timestamp_ntz")
    return trials.agg(
        F.count_if(F.col("expires_at") > moment).alias("active_trials"),
        F.count_if(F.col("expires_at") <= moment).alias("expired_trials"),
    )


def override_prices(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """Custom prices replace the default of the same model and add new models."""
    c = custom.select(
        "model_id",
        F.col("prompt_price").alias("custom_prompt"),
        F.col("completion_price").alias("custom_completion"),
    )
    return defaults.join(c, "model_id", "full_outer").select(
        "model_id",
        F.coalesce("custom_prompt", "prompt_price").alias("prompt_price"),
        F.coalesce("custom_completion", "completion_price").alias("completion_price"),
    )


def call_cost(calls: DataFrame, prices: DataFrame, digits: int | None = None) -> DataFrame:
    """Cost of every call; a model without a price costs nothing.

    No broadcast hint: the price list comes from the caller, and Spark broadcasts it by itself when its size allows.
    """
    priced = calls.join(prices, "model_id", "left")
    cost = F.col("prompt_tokens") / F.lit(1e6) * F.coalesce("prompt_price", F.lit(0.0)) + F.col(
        "completion_tokens"
    ) / F.lit(1e6) * F.coalesce("completion_price", F.lit(0.0))
    return priced.withColumn("cost", F.round(cost, digits) if digits is not None else cost).drop(
        "prompt_price", "completion_price"
    )


def session_costs(costed: DataFrame) -> DataFrame:
    """Totals per session with a map model -> cost."""
    by_model = costed.groupBy("session_id", "model_id").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("cost"),
    )
    return by_model.groupBy("session_id").agg(
        F.sum("calls").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("cost").alias("cost"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", "cost")))).alias("cost_by_model"),
    )


def run_totals(calls: DataFrame) -> DataFrame:
    """Totals of a chain or fan-out run; failed answers cost nothing; the last step's output wins."""
    ok = ~F.col("error")
    return calls.groupBy("session_id").agg(
        F.count("*").alias("steps"),
        F.sum(F.when(ok, F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(0)).alias("total_tokens"),
        F.sum(F.when(ok, F.col("cost")).otherwise(0.0)).alias("total_cost"),
        F.bool_or("error").alias("has_error"),
        F.max_by("output", "step").alias("last_output"),
    )


def running_costs(costed: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """Running token and cost totals per session and model, in call order."""
    keys = ["session_id", "model_id"]
    bucket = ordered.bucket_of("call_id", bucket_width)
    tokens = (F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint")
    values = {"running_tokens": tokens, "running_cost": F.col("cost")}
    return ordered.running_sums(costed, keys, ["call_id"], values, bucket)
