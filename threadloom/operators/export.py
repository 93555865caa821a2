"""Context packs: the selected content of a conversation rendered for a target format.

All inputs are tables keyed by conv_id whose size per conversation the token budget bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions import text as T

TARGETS = ["openai", "claude", "gemini"]
TOP_ENTITIES = 15
TOP_ARTIFACTS = 5
LARGE_CONTEXT = 16_000

# fixed values: suggested model below and above a large context
MODELS = {
    "openai": ("gpt-4o-mini", "gpt-4o"),
    "claude": ("claude-haiku-4-5-20251001", "claude-sonnet-4-20250514"),
    "gemini": ("gemini-1.5-flash", "gemini-1.5-pro"),
}
# fixed values: phrases of the packs
HANDOVER = "You are continuing a conversation that was started with a different AI assistant."
HANDOVER_GEMINI = "You are continuing a conversation started with a different AI assistant."
CLOSING_OPENAI = (
    "\nContinue the conversation naturally, respecting all decisions made and tasks identified. Do not repeat information"
    " the user already knows."
)
CLOSING_CLAUDE = (
    "Continue naturally. Respect all prior decisions and open tasks. Do not repeat information already established."
)
CLOSING_GEMINI = (
    "Continue the conversation naturally. Respect all prior decisions. Do not repeat established information."
)
READY = "I have the full context from your previous conversation. "


def lines(df: DataFrame, line: Column, order: list[Column], name: str) -> DataFrame:
    """The lines of a conversation in order, one text per conversation."""
    rows = df.select("conv_id", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")).alias("r"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("l"))
    return listed.select("conv_id", F.array_join("l.line", "\n").alias(name))


def context_summary(
    conversations: DataFrame,
    summaries: DataFrame,
    entities: DataFrame,
    decisions: DataFrame | None = None,
    tasks: DataFrame | None = None,
    artifacts: DataFrame | None = None,
    preferences: DataFrame | None = None,
) -> DataFrame:
    """Sections in fixed order: summary, topics, entities, decisions, tasks, artifacts, preferences.

    summaries(conv_id, level, content, first_turn), entities(conv_id, name, type, aliases, importance, rank),
    decisions/tasks(conv_id, ix, description, rationale, status), artifacts(conv_id, ix, type, language, title),
    preferences(conv_id, tone, detail_level, domain_expertise).
    """
    level = F.col("level")
    out = conversations.select("conv_id")
    first_global = summaries.where(level == "global").groupBy("conv_id").agg(F.min("content").alias("s_global"))
    topic_lines = lines(
        summaries.where(level == "topic"), F.concat(F.lit("- "), F.substring("content", 1, 200)), [F.col("first_turn")], "s_topics"
    )
    top = ordered.top_rows(entities, ["conv_id"], [F.desc("importance"), F.asc("rank")], TOP_ENTITIES, "nth")
    aka = F.when(F.size("aliases") > 0, F.concat(F.lit(" (aka "), F.array_join("aliases", ", "), F.lit(")"))).otherwise("")
    entity_line = F.concat(F.lit("- **"), "name", F.lit("**"), aka, F.lit(" ["), "type", F.lit("]"))
    out = (
        out.join(first_global, "conv_id", "left")
        .join(topic_lines, "conv_id", "left")
        .join(lines(top, entity_line, [F.col("nth")], "s_entities"), "conv_id", "left")
    )
    sections = [
        F.concat(F.lit("## Previous Conversation Summary\n"), "s_global"),
        F.concat(F.lit("\n## Key Topics\n"), "s_topics"),
        F.concat(F.lit("\n## Key Entities\n"), "s_entities"),
    ]
    if decisions is not None:
        why = F.when(F.col("rationale") != "", F.concat(F.lit("\n  Rationale: "), F.substring("rationale", 1, 200))).otherwise("")
        active = decisions.where(F.col("status") == "active")
        out = out.join(
            lines(active, F.concat(F.lit("- "), "description", why), [F.col("ix")], "s_decisions"), "conv_id", "left"
        )
        sections.append(F.concat(F.lit("\n## Active Decisions\n"), "s_decisions"))
    if tasks is not None:
        active = tasks.where(F.col("status") == "active")
        out = out.join(lines(active, F.concat(F.lit("- "), "description"), [F.col("ix")], "s_tasks"), "conv_id", "left")
        sections.append(F.concat(F.lit("\n## Open Tasks\n"), "s_tasks"))
    if artifacts is not None:
        first = ordered.top_rows(artifacts, ["conv_id"], [F.asc("ix")], TOP_ARTIFACTS, "nth")
        title = F.when(F.col("title") != "", F.col("title")).otherwise(F.concat("type", F.lit(" ("), "language", F.lit(")")))
        n = artifacts.groupBy("conv_id").agg(F.count("*").alias("n_artifacts"))
        out = out.join(n, "conv_id", "left").join(
            lines(first, F.concat(F.lit("- "), title), [F.col("nth")], "s_artifacts"), "conv_id", "left"
        )
        head = F.concat(F.lit("\n## Artifacts ("), F.col("n_artifacts").cast("string"), F.lit(" items)\n"))
        sections.append(F.concat(head, "s_artifacts"))
    if preferences is None:
        out = out.withColumns({"tone": F.lit("technical"), "detail_level": F.lit("detailed"), "domains": F.lit("")})
    else:
        p = preferences.select("conv_id", "tone", "detail_level", F.array_join("domain_expertise", ", ").alias("domains"))
        out = out.join(p, "conv_id", "left")
    sections.append(
        F.concat(
            F.lit("\n## User Preferences\n- Tone: "), "tone", F.lit("\n- Detail: "), "detail_level",
            F.when(F.col("domains") != "", F.concat(F.lit("\n- Expertise: "), "domains")).otherwise(""),
        )
    )
    return out.select("conv_id", F.concat_ws("\n", *sections).alias("context_summary"))


def _fenced(prefix: str, suffix_fenced: str, suffix: str) -> Column:
    """How an artifact is quoted: fenced when its language is known."""
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("type"))
    fenced = F.concat(
        F.lit(prefix), title, F.lit(suffix_fenced + ":\n```"), "language", F.lit("\n"), "content", F.lit("\n```")
    )
    return F.when(F.col("language") != "", fenced).otherwise(F.concat(F.lit(prefix), title, F.lit(suffix + ":\n"), "content"))


def pack_inputs(
    conversations: DataFrame, summaries_text: DataFrame, tasks: DataFrame | None = None, artifacts: DataFrame | None = None
) -> DataFrame:
    """One row per conversation: summary text, message count, open tasks and quoted artifacts (five at most)."""
    out = conversations.select("conv_id", "source_llm", "message_count", "entity_count", "summary_count").join(
        summaries_text, "conv_id"
    )
    if tasks is not None:
        active = tasks.where(F.col("status") == "active")
        n = active.groupBy("conv_id").agg(F.count("*").alias("n_tasks"))
        top = ordered.top_rows(active, ["conv_id"], [F.asc("ix")], 5, "nth")
        listed = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "description"))).alias("t"))
        out = out.join(n, "conv_id", "left").join(
            listed.select("conv_id", F.col("t.description").alias("open_tasks")), "conv_id", "left"
        )
    else:
        out = out.withColumns({"n_tasks": F.lit(0).cast("bigint"), "open_tasks": F.array().cast("array<string>")})
    if artifacts is not None:
        first = ordered.top_rows(artifacts, ["conv_id"], [F.asc("ix")], TOP_ARTIFACTS, "nth")
        has_content = F.col("content") != ""
        quoted = first.select(
            "conv_id", "nth",
            _fenced("Here's the ", " we created", "").alias("openai"),
            F.when(has_content, _fenced("Previous artifact (", ")", ")")).alias("claude"),
            F.when(has_content, _fenced("Previous ", "", "")).alias("gemini"),
        )
        listed = quoted.groupBy("conv_id").agg(
            F.array_sort(F.collect_list(F.struct("nth", "openai", "claude", "gemini"))).alias("a")
        )
        out = out.join(listed, "conv_id", "left")
        for target in TARGETS:
            items = F.coalesce(F.col(f"a.{target}"), F.array().cast("array<string>"))
            out = out.withColumn(f"artifacts_{target}", F.filter(items, lambda x: x.isNotNull()))
        out = out.drop("a")
    else:
        out = out.withColumns({f"artifacts_{t}": F.array().cast("array<string>") for t in TARGETS})
    return out.withColumns(
        {
            "n_tasks": F.coalesce("n_tasks", F.lit(0)),
            "open_tasks": F.coalesce("open_tasks", F.array().cast("array<string>")),
        }
    )


def _tasks(n: int, size: int, separator: str, bullet: str = "") -> Column:
    return F.array_join(
        F.transform(F.slice("open_tasks", 1, n), lambda d: F.concat(F.lit(bullet), F.substring(d, 1, size))), separator
    )


def _by_tasks(with_tasks: Column, without: str) -> Column:
    return F.when(F.col("n_tasks") > 0, with_tasks).otherwise(F.lit(without))


def _openai(rows: DataFrame) -> DataFrame:
    system = F.concat_ws(
        "\n",
        F.lit(HANDOVER),
        F.concat(F.lit("The conversation had "), F.col("message_count").cast("string"), F.lit(" messages and covered the following context:\n")),
        "context_summary",
        F.lit(CLOSING_OPENAI),
    )
    last = _by_tasks(
        F.concat(F.lit(READY + "The open tasks are: "), _tasks(3, 80, ", "), F.lit(". How would you like to continue?")),
        READY + "How would you like to continue?",
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    shown = F.filter("artifacts_openai", lambda x: x != "")
    messages = F.concat(
        F.array(message("system", system)), F.transform(shown, lambda a: message("assistant", a)), F.array(message("assistant", last))
    )
    text = F.concat(system, F.array_join(shown, ""), last)
    return rows.select("conv_id", F.lit("openai").alias("target"), system.alias("system_prompt"), F.to_json(messages).alias("messages"),
                       T.token_estimate(text).alias("token_estimate"), "source_llm", "entity_count", "summary_count")


def _claude(rows: DataFrame) -> DataFrame:
    system = F.concat_ws(
        "\n",
        F.lit(HANDOVER),
        F.concat(F.lit("The original conversation had "), F.col("message_count").cast("string"), F.lit(" messages.")),
        F.lit(""), "context_summary", F.lit(""), F.lit(CLOSING_CLAUDE),
    )
    pick_up = F.concat(
        F.lit("We have "), F.col("n_tasks").cast("string"), F.lit(" open task(s). Please pick up where we left off.")
    )
    opening = F.concat(
        F.lit("I'm continuing a conversation from another AI assistant. You should have the full context in your system prompt. "),
        _by_tasks(pick_up, "Please pick up where we left off."),
    )
    answer = _by_tasks(
        F.concat(F.lit(READY + "Here are the open tasks:\n"), _tasks(5, 100, "\n", "- "), F.lit("\n\nWhat would you like to work on?")),
        READY + "I'm ready to continue. What would you like to do next?",
    )
    block = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    first = F.array(block(opening))
    second = F.concat(F.array(block(answer)), F.transform("artifacts_claude", block))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("user", first), message("assistant", second))
    text = F.concat(system, F.to_json(first), F.to_json(second))
    return rows.select("conv_id", F.lit("claude").alias("target"), system.alias("system_prompt"), F.to_json(messages).alias("messages"),
                       T.token_estimate(text).alias("token_estimate"), "source_llm", "entity_count", "summary_count")


def _gemini(rows: DataFrame) -> DataFrame:
    system = F.concat_ws(
        "\n",
        F.lit(HANDOVER_GEMINI),
        F.concat(F.lit("The original conversation had "), F.col("message_count").cast("string"), F.lit(" messages.")),
        F.lit(""), "context_summary", F.lit(""), F.lit(CLOSING_GEMINI),
    )
    intro = "I'm continuing a conversation from another AI. "
    opening = _by_tasks(
        F.concat(F.lit(intro + "We have "), F.col("n_tasks").cast("string"), F.lit(" open task(s). Please continue where we left off.")),
        intro + "Please continue where we left off.",
    )
    answer = _by_tasks(
        F.concat(F.lit("I have the full context. Open tasks: "), _tasks(3, 80, ", "), F.lit(". What would you like to focus on?")),
        READY + "How can I help?",
    )
    part = lambda text: F.struct(text.alias("text"))
    first = F.array(part(opening))
    second = F.concat(F.array(part(answer)), F.transform("artifacts_gemini", part))
    message = lambda role, parts: F.struct(F.lit(role).alias("role"), parts.alias("parts"))
    messages = F.array(message("user", first), message("model", second))
    text = F.concat(system, F.to_json(first), F.to_json(second))
    return rows.select("conv_id", F.lit("gemini").alias("target"), system.alias("system_prompt"), F.to_json(messages).alias("messages"),
                       T.token_estimate(text).alias("token_estimate"), "source_llm", "entity_count", "summary_count")


_RENDER = {"openai": _openai, "claude": _claude, "gemini": _gemini}


def suggested_model(target: str, tokens: Column) -> Column:
    small, large = MODELS[target]
    return F.when(tokens > LARGE_CONTEXT, F.lit(large)).otherwise(F.lit(small))


def packs(rows: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Packs of every conversation for every wanted target; an unknown target is an error."""
    out = None
    for target in TARGETS if targets is None else targets:
        if target not in _RENDER:
            raise ValueError(f"unknown target {target!r}; known: {', '.join(sorted(_RENDER))}")
        part = _RENDER[target](rows).withColumn("model_suggestion", suggested_model(target, F.col("token_estimate")))
        out = part if out is None else out.unionByName(part)
    return out


def write_packs(pack_rows: DataFrame, path: str) -> None:
    """One job renders all targets; readers of one target touch only its partition."""
    pack_rows.write.mode("append").partitionBy("target").parquet(path)


def stored_packs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The packs of the targets that a table `wanted(target, ...)` names, with its other columns.

    `wanted` has one row per target at most.  The join on the partition column prunes at run time: partitions of targets
    that the filters on `wanted` leave out are never listed for reading.
    """
    packs = spark.read.parquet(path)
    return packs.join(F.broadcast(wanted.dropDuplicates(["target"])), "target")


def previews(pack_rows: DataFrame, stats: DataFrame) -> DataFrame:
    """What a pack would hold, without the pack."""
    sizes = pack_rows.select("conv_id", "target", F.col("token_estimate").alias("estimated_output_tokens"))
    return stats.select("conv_id", "source_format", "message_count", "entity_count", "summary_count").join(sizes, "conv_id")
