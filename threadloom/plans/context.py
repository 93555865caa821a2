"""The whole path from conversations to context packs, and the budget queries along it."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import budget as B
from threadloom.operators import entities as E
from threadloom.operators import export as X
from threadloom.operators import summaries as S
from threadloom.plans import entities as PE
from threadloom.plans import ingest as PI
from threadloom.plans.registry import query
from threadloom.plans.summaries import VIEWS as SUMMARY_VIEWS
from threadloom.plans.summaries import messages
from threadloom.session import saved, shared_folder
from threadloom.sources import dialects as D
from threadloom.sources.testviews import table

BUDGET = 300

VIEWS = {
    **SUMMARY_VIEWS,
    **PE.VIEWS,
    "v_tokens_of": "SELECT CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, length(t) // 4) END AS n FROM (SELECT '' AS t)",
    "v_artifacts": (
        "SELECT conv_id, turn AS ix, full_text AS content, CASE WHEN turn % 4 = 1 THEN 'Reply ' || turn ELSE '' END AS title"
        " FROM v_messages WHERE role = 'assistant'"
    ),
    "v_artifact_costs": (
        "SELECT *, greatest(1, length(content) // 4) + tt AS tokens, greatest(1, length(cut) // 4) + tt AS cut_tokens FROM"
        " (SELECT *, CASE WHEN length(title) = 0 THEN 0 ELSE greatest(1, length(title) // 4) END AS tt, CASE WHEN nl - 1 >"
        " 60 THEN substr(head, 1, nl - 1) ELSE head END || chr(10) || '... [truncated]' AS cut FROM (SELECT *, CASE WHEN"
        " contains(head, chr(10)) THEN length(head) - instr(reverse(head), chr(10)) + 1 ELSE 0 END AS nl FROM (SELECT *,"
        " substr(content, 1, 120) AS head FROM v_artifacts)))"
    ),
    "v_entity_costs": (
        "SELECT s.conv_id, s.low, s.rank, s.importance, greatest(1, (length(s.name) + coalesce(p.n, 0) * 11) // 4) AS tokens"
        " FROM v_scored_entities s LEFT JOIN (SELECT conv_id, src, count(*) AS n FROM v_pairs GROUP BY ALL) p ON p.conv_id ="
        " s.conv_id AND p.src = s.low"
    ),
    "v_items": (
        "SELECT conv_id, level AS kind, level || ':' || first_turn || ':' || last_turn AS item_id, 0 AS cat, CASE level WHEN"
        " 'message' THEN 0 WHEN 'topic' THEN 1 ELSE 2 END * 100000 + first_turn AS o, CASE WHEN token_count > 0 THEN"
        " token_count ELSE greatest(1, length(content) // 4) END AS tokens, CASE level WHEN 'message' THEN 1.0 WHEN 'topic'"
        " THEN 3.0 ELSE 10.0 END AS priority, CAST(NULL AS BIGINT) AS cut FROM v_summaries UNION ALL SELECT conv_id, 'entity',"
        " low, 1, rank, tokens, 2.0 * (0.5 + importance), NULL FROM v_entity_costs UNION ALL SELECT conv_id, 'artifact',"
        " CAST(ix AS VARCHAR), 2, ix, tokens, 2.5, CASE WHEN tokens > 30 THEN cut_tokens END FROM v_artifact_costs"
    ),
    "v_totals": "SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS total FROM v_items GROUP BY 1",
    "v_events": (
        "SELECT conv_id, kind, item_id, cat, o, priority AS p, tokens - cut AS saving, 'truncate' AS action FROM v_items WHERE"
        " kind = 'artifact' AND tokens - cut > 0 UNION ALL SELECT conv_id, kind, item_id, cat, o, priority + 50, cut, 'drop'"
        " FROM v_items WHERE kind = 'artifact' AND tokens - cut > 0 UNION ALL SELECT conv_id, kind, item_id, cat, o, priority,"
        " tokens, 'drop' FROM v_items WHERE kind <> 'global' AND NOT (kind = 'artifact' AND coalesce(tokens - cut, 0) > 0)"
    ),
    "v_applied": (
        "SELECT * FROM (SELECT e.*, t.total, coalesce(sum(saving) OVER (PARTITION BY e.conv_id ORDER BY p, cat DESC, o DESC ROWS"
        f" BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM v_events e JOIN v_totals t ON t.conv_id = e.conv_id)"
        f" WHERE total > {BUDGET} AND total - gone > {BUDGET}"
    ),
    "v_selected": (
        "SELECT i.*, coalesce(a.dropped, FALSE) AS dropped, CAST(i.tokens - coalesce(a.saved, 0) AS BIGINT) AS final_tokens FROM"
        " v_items i LEFT JOIN (SELECT conv_id, kind, item_id, bool_or(action = 'drop') AS dropped, sum(saving) AS saved FROM"
        " v_applied GROUP BY ALL) a ON a.conv_id = i.conv_id AND a.kind = i.kind AND a.item_id = i.item_id"
    ),
}


def artifacts(spark, sf_dir):
    m = messages(spark, sf_dir).where("role = 'assistant'")
    title = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("Reply "), F.col("turn").cast("string"))).otherwise("")
    return m.select(
        "conv_id", F.col("turn").alias("ix"), F.lit("document").alias("type"), F.lit("").alias("language"),
        title.alias("title"), F.col("full_text").alias("content"),
    )


def items(spark, sf_dir):
    scored, relationships, _ = PE.scored(spark, sf_dir)
    return (
        B.summary_items(S.all_summaries(messages(spark, sf_dir)))
        .unionByName(B.entity_items(scored, relationships))
        .unionByName(B.artifact_items(artifacts(spark, sf_dir), 30))
    )


@query(
    "budget_items", "K1 K2",
    "SELECT conv_id, kind, item_id, CAST(tokens AS BIGINT) AS tokens, round(CAST(priority AS DOUBLE), 6) AS priority, cut AS"
    " truncated_tokens FROM v_items",
    VIEWS,
)
def budget_items(spark, sf_dir):
    return items(spark, sf_dir).select(
        "conv_id", "kind", "item_id", "tokens", F.round("priority", 6).alias("priority"), "truncated_tokens"
    )


@query(
    "budget_selection", "K3 K4 K5", "SELECT conv_id, kind, item_id, dropped, final_tokens FROM v_selected", VIEWS,
)
def budget_selection(spark, sf_dir):
    # Written once: the totals and the ordered step both read the items.
    chosen = B.select_within(saved(items(spark, sf_dir), "items"), BUDGET)
    return chosen.select("conv_id", "kind", "item_id", "dropped", "final_tokens")


@query(
    "budget_stats", "K6",
    """
SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS original_tokens, CAST(sum(final_tokens) AS BIGINT) AS total_tokens,
    CAST(count_if(dropped) AS BIGINT) AS items_dropped, round(sum(final_tokens) / sum(tokens), 4) AS compression_ratio FROM
    v_selected GROUP BY 1
""",
    VIEWS,
)
def budget_stats(spark, sf_dir):
    return B.selection_stats(B.select_within(saved(items(spark, sf_dir), "items"), BUDGET))


def finished(spark, sf_dir, exports=None, budget=B.TOKEN_BUDGET):
    """Raw exports -> messages -> entities, summaries -> selection; every shared intermediate is written once."""
    conversations, spoken = D.normalize(PI.raw_openai(spark, sf_dir) if exports is None else exports, ("openai",))
    spoken = spoken.select("conv_id", "turn", "role", "full_text", "blocks")
    if exports is None:
        # Long conversations come in several exports; from here on they are one again.
        spoken = PI.whole(spoken)
        conversations = conversations.withColumn("conv_id", F.expr(f"conv_id div {PI.PARTS}"))
        conversations = conversations.groupBy("conv_id", "source_format", "source_llm").agg(F.max("source_model").alias("source_model"))
    spoken = saved(spoken, "messages")
    m = spoken.drop("blocks")
    mentions = saved(E.all_mentions(m, PE.dictionary(spark, sf_dir), D.block_rows(spoken)), "mentions")
    raw = saved(E.raw_entities(mentions), "raw")
    resolved = saved(E.resolve(raw), "resolved")
    found = E.entities_of(raw, resolved)
    relationships = saved(E.cooccurrence(mentions, resolved).unionByName(E.verb_edges(m, found)), "relationships")
    scored = saved(E.with_importance(found, relationships, m), "entities")
    topics = S.merge_small_segments(S.segment_topics(m))
    summaries = saved(S.all_summaries(m), "summaries")
    everything = saved(B.summary_items(summaries).unionByName(B.entity_items(scored, relationships)), "items")
    selected = saved(B.select_within(everything, budget), "selected")
    extents = topics.select("conv_id", "topic").distinct()
    stats = B.generation_stats(conversations, m, selected, relationships, extents)
    return conversations, m, scored, summaries, selected, saved(stats, "stats")


@query("generation_stats", "K7")
def generation_stats(spark, sf_dir):
    return finished(spark, sf_dir, budget=BUDGET)[-1]


def kept_content(scored, summaries, selected):
    kept = selected.where(~F.col("dropped"))
    item_id = F.concat_ws(":", "level", F.col("first_turn").cast("string"), F.col("last_turn").cast("string"))
    kept_summaries = summaries.withColumn("item_id", item_id).join(
        kept.where(F.col("kind").isin("message", "topic", "global")).select("conv_id", "item_id"), ["conv_id", "item_id"], "left_semi"
    )
    kept_entities = scored.join(
        kept.where("kind = 'entity'").select("conv_id", F.col("item_id").alias("low")), ["conv_id", "low"], "left_semi"
    )
    return kept_summaries, kept_entities


@query("context_packs", "O2 O3 O4 O6")
def context_packs(spark, sf_dir):
    """The flagship: every conversation as a pack for every target."""
    _, _, scored, summaries, selected, stats = finished(spark, sf_dir)
    kept_summaries, kept_entities = kept_content(scored, summaries, selected)
    text = X.context_summary(stats, kept_summaries, kept_entities)
    return X.packs(X.pack_inputs(stats, text))


@query("shift_previews", "O7")
def shift_previews(spark, sf_dir):
    _, _, scored, summaries, selected, stats = finished(spark, sf_dir)
    kept_summaries, kept_entities = kept_content(scored, summaries, selected)
    text = X.context_summary(stats, kept_summaries, kept_entities)
    return X.previews(X.packs(X.pack_inputs(stats, text)), stats)


# -- context text and packs from tables whose oracle SQL can say --------------------------------------------------------------

CONTEXT_TEXT = (
    "SELECT c.conv_id, concat_ws(chr(10), '## Previous Conversation Summary' || chr(10) || g.content, chr(10) || '## Key"
    " Topics' || chr(10) || t.lines, chr(10) || '## Key Entities' || chr(10) || e.lines, chr(10) || '## Active Decisions' ||"
    " chr(10) || d.lines, chr(10) || '## Open Tasks' || chr(10) || k.lines, chr(10) || '## Artifacts (' || a.n || ' items)' ||"
    " chr(10) || a.lines, chr(10) || '## User Preferences' || chr(10) || '- Tone: technical' || chr(10) || '- Detail:"
    " detailed') AS context_summary FROM (SELECT DISTINCT conv_id FROM v_messages) c"
    " LEFT JOIN v_global_summaries g ON g.conv_id = c.conv_id"
    " LEFT JOIN (SELECT conv_id, string_agg('- ' || substr(content, 1, 200), chr(10) ORDER BY first_turn) AS lines FROM"
    " v_topic_summaries GROUP BY 1) t ON t.conv_id = c.conv_id"
    " LEFT JOIN (SELECT conv_id, string_agg('- **' || name || '** [' || type || ']', chr(10) ORDER BY nth) AS lines FROM"
    " (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY importance DESC, rank) AS nth FROM v_scored_entities) WHERE"
    " nth <= 15 GROUP BY 1) e ON e.conv_id = c.conv_id"
    " LEFT JOIN (SELECT conv_id, string_agg('- ' || full_text || CASE WHEN turn % 2 = 0 THEN chr(10) || '"
    "  Rationale: ' || role ELSE '' END, chr(10) ORDER BY turn) AS lines FROM v_messages WHERE turn % 3 = 0 GROUP BY 1) d ON"
    " d.conv_id = c.conv_id"
    " LEFT JOIN (SELECT conv_id, string_agg('- ' || full_text, chr(10) ORDER BY turn) AS lines FROM v_messages"
    " WHERE turn % 3 = 1 GROUP BY 1) k ON k.conv_id = c.conv_id"
    " LEFT JOIN (SELECT conv_id, count(*) AS n, string_agg('- ' || CASE WHEN title <> '' THEN title ELSE 'document ()' END,"
    " chr(10) ORDER BY ix) FILTER (WHERE nth <= 5) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY"
    " ix) AS nth FROM v_artifacts) GROUP BY 1) a ON a.conv_id = c.conv_id"
)
VIEWS["v_context_text"] = CONTEXT_TEXT


def decisions_and_tasks(spark, sf_dir):
    m = messages(spark, sf_dir)
    kind = F.col("turn") % 3
    status = lambda k: F.when(kind == k, "active").otherwise("superseded")
    rationale = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    decisions = m.select(
        "conv_id", F.col("turn").alias("ix"), F.col("full_text").alias("description"),
        rationale.alias("rationale"), status(0).alias("status"),
    )
    tasks = m.select(
        "conv_id", F.col("turn").alias("ix"), F.col("full_text").alias("description"), status(1).alias("status")
    )
    return decisions, tasks


def context_text(spark, sf_dir):
    m = messages(spark, sf_dir)
    scored, _, _ = PE.scored(spark, sf_dir)
    decisions, tasks = decisions_and_tasks(spark, sf_dir)
    everyone = m.select("conv_id").distinct()
    return X.context_summary(everyone, S.all_summaries(m), scored, decisions, tasks, artifacts(spark, sf_dir))


@query("context_summaries", "O1", "SELECT * FROM v_context_text", VIEWS)
def context_summaries(spark, sf_dir):
    return context_text(spark, sf_dir)


@query(
    "openai_packs", "O2 O5",
    """
SELECT conv_id, system_prompt, CAST(greatest(1, (length(system_prompt) + coalesce(length(quoted), 0) + length(last)) // 4) AS
    INT) AS token_estimate, CASE WHEN greatest(1, (length(system_prompt) + coalesce(length(quoted), 0) + length(last)) // 4) >
    16000 THEN 'gpt-4o' ELSE 'gpt-4o-mini' END AS model_suggestion, last AS last_message
FROM (SELECT t.conv_id, 'You are continuing a conversation that was started with a different AI assistant.' || chr(10) ||
    'The conversation had ' || n || ' messages and covered the following context:' || chr(10) || chr(10) || context_summary ||
    chr(10) || chr(10) || 'Continue the conversation naturally, respecting all decisions made and tasks identified. Do not
repeat information the user already knows.' AS system_prompt, a.quoted, 'I have the full context from your previous
conversation. ' || CASE WHEN k.list IS NULL THEN 'How would you like to continue?' ELSE 'The open tasks are: ' || k.list || '.
How would you like to continue?' END AS last
    FROM v_context_text t JOIN (SELECT conv_id, count(*) AS n FROM v_messages GROUP BY 1) m ON m.conv_id = t.conv_id
    LEFT JOIN (SELECT conv_id, string_agg('Here''s the ' || CASE WHEN title <> '' THEN title ELSE 'document' END || ':' ||
    chr(10) || content, '' ORDER BY ix) AS quoted FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ix) AS nth
    FROM v_artifacts) WHERE nth <= 5 GROUP BY 1) a ON a.conv_id = t.conv_id
    LEFT JOIN (SELECT conv_id, string_agg(substr(full_text, 1, 80), ', ' ORDER BY turn) AS list FROM (SELECT *, row_number()
    OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM v_messages WHERE turn % 3 = 1) WHERE nth <= 3 GROUP BY 1) k ON
    k.conv_id = t.conv_id)
""".replace("Do not\nrepeat", "Do not repeat").replace("previous\nconversation", "previous conversation").replace("'.\nHow", "'. How"),
    VIEWS,
)
def openai_packs(spark, sf_dir):
    text = saved(context_text(spark, sf_dir), "context")
    m = messages(spark, sf_dir)
    heads = m.groupBy("conv_id").agg(F.count("*").alias("message_count")).withColumns(
        {"source_llm": F.lit("openai"), "entity_count": F.lit(0), "summary_count": F.lit(0)}
    )
    _, tasks = decisions_and_tasks(spark, sf_dir)
    rows = X.pack_inputs(heads, text, tasks, artifacts(spark, sf_dir))
    out = X.packs(rows, ["openai"])
    sent = F.from_json("messages", "array<struct<role:string,content:string>>")
    return out.select(
        "conv_id", "system_prompt", "token_estimate", "model_suggestion", F.element_at(sent, -1)["content"].alias("last_message")
    )


# One row per conversation and target, in the words of each target.
_PICK_UP = "Please pick up where we left off."
_PACK_TEXTS = """
SELECT t.conv_id, n, coalesce(k.n_tasks, 0) AS n_tasks, context_summary, three, five, claude, gemini, quoted, n_claude FROM
    v_context_text t JOIN (SELECT conv_id, count(*) AS n FROM v_messages GROUP BY 1) m ON m.conv_id = t.conv_id
LEFT JOIN (SELECT conv_id, max(nth) AS n_tasks, string_agg(substr(full_text, 1, 80), ', ' ORDER BY turn) FILTER (nth <= 3) AS three,
    string_agg('- ' || substr(full_text, 1, 100), chr(10) ORDER BY turn) FILTER (nth <= 5) AS five FROM (SELECT *, row_number() OVER
    (PARTITION BY conv_id ORDER BY turn) AS nth FROM v_messages WHERE turn % 3 = 1) GROUP BY 1) k ON k.conv_id = t.conv_id
LEFT JOIN (SELECT conv_id, count(*) AS n_claude, list({'type': 'text', 'text': 'Previous artifact (' || label || '):' || chr(10) || content} ORDER BY
    ix) AS claude, list({'text': 'Previous ' || label || ':' || chr(10) || content} ORDER BY ix) AS gemini FROM (SELECT *, CASE WHEN title <> ''
    THEN title ELSE 'document' END AS label, row_number() OVER (PARTITION BY conv_id ORDER BY ix) AS nth FROM v_artifacts) WHERE
    nth <= 5 AND content <> '' GROUP BY 1) a ON a.conv_id = t.conv_id
LEFT JOIN (SELECT conv_id, string_agg('Here''s the ' || CASE WHEN title <> '' THEN title ELSE 'document' END || ':' || chr(10) || content, ''
    ORDER BY ix) AS quoted FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ix) AS nth FROM v_artifacts) WHERE
    nth <= 5 GROUP BY 1) q ON q.conv_id = t.conv_id
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_system(handover: str, closing: str) -> str:
    return (
        f"{_sql_text(handover)} || chr(10) || 'The original conversation had ' || n || ' messages.' || chr(10) || chr(10) ||"
        f" context_summary || chr(10) || chr(10) || {_sql_text(closing)}"
    )


_CLAUDE_OPENING = (
    _sql_text("I'm continuing a conversation from another AI assistant. You should have the full context in your system prompt. ")
    + f" || CASE WHEN n_tasks > 0 THEN 'We have ' || n_tasks || ' open task(s). Please pick up where we left off.' ELSE '{_PICK_UP}' END"
)
_CLAUDE_ANSWER = (
    f"CASE WHEN n_tasks > 0 THEN {_sql_text(X.READY)} || 'Here are the open tasks:' || chr(10) || five || chr(10) || chr(10) ||"
    f" 'What would you like to work on?' ELSE {_sql_text(X.READY)} || 'I''m ready to continue. What would you like to do next?' END"
)
_GEMINI_OPENING = (
    _sql_text("I'm continuing a conversation from another AI. ")
    + " || CASE WHEN n_tasks > 0 THEN 'We have ' || n_tasks || ' open task(s). Please continue where we left off.' ELSE"
    " 'Please continue where we left off.' END"
)
_GEMINI_ANSWER = (
    "CASE WHEN n_tasks > 0 THEN 'I have the full context. Open tasks: ' || three || '. What would you like to focus on?' ELSE"
    f" {_sql_text(X.READY)} || 'How can I help?' END"
)
VIEWS |= {
    "v_pack_texts": _PACK_TEXTS,
    "v_claude": (
        f"SELECT conv_id, {_sql_system(X.HANDOVER, X.CLOSING_CLAUDE)} AS system_prompt, CAST(to_json([{{'type': 'text', 'text': {_CLAUDE_OPENING}}}])"
        f" AS VARCHAR) AS first, CAST(to_json(list_concat([{{'type': 'text', 'text': {_CLAUDE_ANSWER}}}], coalesce(claude, []))) AS VARCHAR) AS second"
        " FROM v_pack_texts"
    ),
    "v_gemini": (
        f"SELECT conv_id, {_sql_system(X.HANDOVER_GEMINI, X.CLOSING_GEMINI)} AS system_prompt, CAST(to_json([{{'text': {_GEMINI_OPENING}}}]) AS"
        f" VARCHAR) AS first, CAST(to_json(list_concat([{{'text': {_GEMINI_ANSWER}}}], coalesce(gemini, []))) AS VARCHAR) AS second FROM"
        " v_pack_texts"
    ),
    # The open-format pack by its length only: system text, quoted artifacts and the closing message.
    "v_openai_length": (
        "SELECT conv_id, length('You are continuing a conversation that was started with a different AI assistant.' || chr(10) || 'The"
        " conversation had ' || n || ' messages and covered the following context:' || chr(10) || chr(10) || context_summary || chr(10) ||"
        f" {_sql_text(X.CLOSING_OPENAI)}) + coalesce(length(quoted), 0) + length({_sql_text(X.READY)} || CASE WHEN n_tasks > 0 THEN 'The open tasks"
        " are: ' || three || '. How would you like to continue?' ELSE 'How would you like to continue?' END) AS chars FROM v_pack_texts"
    ),
    "v_all_packs": (
        "SELECT conv_id, 'claude' AS target, length(system_prompt || first || second) AS chars FROM v_claude UNION ALL SELECT conv_id, 'gemini',"
        " length(system_prompt || first || second) FROM v_gemini UNION ALL SELECT conv_id, 'openai', chars FROM v_openai_length"
    ),
}


def pack_rows(spark, sf_dir, targets=None):
    text = saved(context_text(spark, sf_dir), "context")
    heads = messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("message_count")).withColumns(
        {"source_llm": F.lit("openai"), "entity_count": F.lit(0), "summary_count": F.lit(0)}
    )
    _, tasks = decisions_and_tasks(spark, sf_dir)
    return X.packs(X.pack_inputs(heads, text, tasks, artifacts(spark, sf_dir)), targets)


def _pack_sql(target, small, large, first, second):
    return f"""
SELECT conv_id, '{target}' AS target, system_prompt, '[{{"role":"user",{first}:' || first || '}},{{"role":"{second[0]}",{second[1]}:' || second || '}}]'
    AS messages, CAST(greatest(1, length(system_prompt || first || second) // 4) AS INT) AS token_estimate, CASE WHEN greatest(1,
    length(system_prompt || first || second) // 4) > {X.LARGE_CONTEXT} THEN '{large}' ELSE '{small}' END AS model_suggestion,
    'openai' AS source_llm, CAST(0 AS INT) AS entity_count, CAST(0 AS INT) AS summary_count FROM v_{target}
"""


@query("claude_packs", "O3 O5", _pack_sql("claude", *X.MODELS["claude"], '"content"', ("assistant", '"content"')), VIEWS)
def claude_packs(spark, sf_dir):
    return pack_rows(spark, sf_dir, ["claude"])


@query("gemini_packs", "O4 O5", _pack_sql("gemini", *X.MODELS["gemini"], '"parts"', ("model", '"parts"')), VIEWS)
def gemini_packs(spark, sf_dir):
    return pack_rows(spark, sf_dir, ["gemini"])


@query(
    "pack_store", "O6",
    """
SELECT conv_id, target, CASE target WHEN 'claude' THEN 'Anthropic' ELSE 'Google' END AS provider, CAST(greatest(1, chars // 4) AS INT)
    AS token_estimate FROM v_all_packs WHERE target <> 'openai'
""",
    VIEWS,
)
def pack_store(spark, sf_dir):
    """All packs written once by target; those of two providers (a filtered table) read by a join on the partition column."""
    path = shared_folder(spark, "packs")
    X.write_packs(pack_rows(spark, sf_dir), path)
    wanted = table(spark, sf_dir, "region").where("r_regionkey IN (1, 2)").selectExpr(
        "try_element_at(array('openai', 'claude', 'gemini'), CAST(r_regionkey + 1 AS INT)) AS target",
        "try_element_at(array('OpenAI', 'Anthropic', 'Google'), CAST(r_regionkey + 1 AS INT)) AS provider",
    )
    return X.stored_packs(spark, path, wanted).select("conv_id", "target", "provider", "token_estimate")


@query(
    "pack_previews", "O7",
    """
SELECT conv_id, target, 'openai' AS source_format, n AS message_count, CAST(0 AS INT) AS entity_count, CAST(0 AS INT) AS summary_count,
    CAST(greatest(1, chars // 4) AS INT) AS estimated_output_tokens, 'openai' AS source_llm FROM v_all_packs JOIN (SELECT conv_id, n FROM
    v_pack_texts) USING (conv_id)
""",
    VIEWS,
)
def pack_previews(spark, sf_dir):
    """Previews of the packs whose texts SQL can say."""
    stats = messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("message_count")).withColumns(
        {"source_format": F.lit("openai"), "entity_count": F.lit(0), "summary_count": F.lit(0)}
    )
    return X.previews(pack_rows(spark, sf_dir), stats).withColumn("source_llm", F.lit("openai"))
