"""Redaction of personal data, detection of prompt injection, and security policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.session import saved


def redact(df: DataFrame, text: str = "full_text", patterns=None) -> DataFrame:
    """Add `cleaned`, `pii_counts` (label -> matches) and `pii_count`.

    The patterns run in order, each on the text the earlier ones left.  A pattern counts where its plainer form finds
    something, and replaces where it counted.  Every stage is its own projection: the planner keeps them apart because a
    stage's text and count are used several times, so no pattern is evaluated twice.
    """
    patterns = fixed.PII_PATTERNS if patterns is None else patterns
    staged = df.withColumn("__t0", F.col(text))
    for i, rule in enumerate(patterns):
        label, _, pattern = rule
        before, after = f"__t{i}", f"__t{i + 1}"
        n = F.regexp_count(before, F.lit(pattern))
        if rule in fixed.PII_PATTERNS:
            n = F.when(~F.rlike(F.col(before), F.lit(fixed.PII_NEEDS[label])), F.lit(0)).otherwise(n)
        replaced = F.regexp_replace(before, pattern, f"[{label}_REDACTED]")
        staged = staged.withColumn(f"__n{i}", n)
        staged = staged.withColumn(after, F.when(F.col(f"__n{i}") > 0, replaced).otherwise(F.col(before)))
    counts = [F.col(f"__n{i}") for i in range(len(patterns))]
    pairs = [x for (label, _, _), c in zip(patterns, counts) for x in (F.lit(label), c)]
    out = staged.withColumns(
        {
            "cleaned": F.col(f"__t{len(patterns)}"),
            "pii_counts": F.create_map(*pairs),
            "pii_count": reduce(lambda a, b: a + b, counts),
        }
    )
    return out.drop(*[f"__t{i}" for i in range(len(patterns) + 1)], *[f"__n{i}" for i in range(len(patterns))])


def flag(kind: str, severity: str, description: Column, action: str, confidence: float) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        description.alias("description"),
        F.lit(action).alias("action"),
        F.lit(confidence).alias("confidence"),
    )


def injection_flags(text: str = "full_text") -> Column:
    """One flag per injection pattern found in the text as it came in (patterns, not matches, are counted)."""
    found = [
        F.when(F.rlike(F.col(text), F.lit(pattern)), flag("injection", severity, F.lit(what), "flagged", 0.85))
        for what, severity, pattern in fixed.INJECTION_PATTERNS
    ]
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def pii_flags() -> Column:
    found = []
    for label, severity, _ in fixed.PII_PATTERNS:
        n = F.element_at("pii_counts", F.lit(label))
        what = F.concat(F.lit(f"{label} detected ("), n.cast("string"), F.lit(" instance(s))"))
        found.append(F.when(n > 0, flag("pii_detected", severity, what, "redacted", 0.95)))
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def has_severity(flags: str | Column, *severities: str) -> Column:
    return F.exists(flags, lambda f: f["severity"].isin(*severities))


def sanitize(messages: DataFrame, text: str = "full_text") -> DataFrame:
    """Add cleaned text, flags, counts and the verdict to every message; stateless, so it also runs on a stream."""
    redacted = redact(messages, text)
    # The injection flags look at the incoming text, which is still a column; the two arrays are joined afterwards.
    flagged = redacted.withColumns({"__injection": injection_flags(text), "__pii": pii_flags()})
    return (
        flagged.withColumns(
            {"flags": F.concat("__pii", "__injection"), "injection_count": F.size("__injection")}
        )
        .withColumn("is_safe", ~has_severity("flags", "critical", "high"))
        .withColumn("is_critical", has_severity("flags", "critical"))
        .drop("__injection", "__pii", "pii_counts")
    )


def safety_flags(sanitized: DataFrame, *keys: str) -> DataFrame:
    """One row per flag with the index of the message it belongs to.

    inline_outer, because the planner would otherwise infer a filter on the flags and push a second copy of all
    patterns below the projection.
    """
    return sanitized.select(*keys, F.inline_outer("flags")).where(F.col("type").isNotNull())


def quarantine(sanitized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that may go on, and messages held back because of a critical flag.

    The sanitized rows are written once: two filters over the unwritten rows would run every pattern for each side.
    """
    sanitized = saved(sanitized, "sanitized")
    return sanitized.where(~F.col("is_critical")), sanitized.where(F.col("is_critical"))


def conversation_safety(sanitized: DataFrame) -> DataFrame:
    return sanitized.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        F.sum("pii_count").alias("pii_count"),
        F.sum("injection_count").alias("injection_count"),
        F.count_if(~F.col("is_safe")).alias("unsafe_messages"),
        F.count_if("is_critical").alias("critical_messages"),
    )


def user_policies(users: DataFrame, policies: DataFrame, mapping: DataFrame) -> DataFrame:
    """The policy of each user's subscription; unknown tiers get the default."""
    named = users.join(mapping, "tier", "left").withColumn("policy", F.coalesce("policy", F.lit("default")))
    return named.join(policies, "policy")


def override_policies(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Rows of `base` overlaid by the non-null columns of `overrides`."""
    changed = [c for c in overrides.columns if c != key]
    renamed = overrides.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    joined = base.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def policy_warnings(policies: DataFrame, key: str) -> DataFrame:
    """One row per inconsistency of a policy."""
    rules = [
        (~F.col("encrypt_at_rest"), "Encryption at rest is disabled -- not recommended"),
        (F.col("retention_days") < 1, "Retention period is less than 1 day"),
        (F.col("retention_days") > 3650, "Retention period exceeds 10 years"),
        (F.col("dlp_enabled") & ~F.col("redact_pii"), "DLP is enabled but PII redaction is disabled"),
        (
            F.col("block_on_critical") & ~F.col("detect_injections"),
            "Block on critical is enabled but injection detection is disabled",
        ),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(w)) for c, w in rules]), lambda w: w.isNotNull())
    return policies.select(key, F.explode(found).alias("warning"))


def retention_split(sessions: DataFrame, users: DataFrame, tiers: DataFrame, now: str) -> DataFrame:
    """Add `expired`: older than the retention of the owner's tier; -1 keeps everything."""
    limits = users.join(tiers.select("tier", "retention_days"), "tier")
    joined = sessions.join(limits.select("user_id", "tier", "retention_days"), "user_id")
    age = F.timestamp_diff("SECOND", F.col("created_at"), F.lit(now).cast("timestamp_ntz")) / F.lit(86400.0)
    expired = (F.col("retention_days") >= 0) & (age > F.col("retention_days"))
    return joined.withColumn("expired", expired)
