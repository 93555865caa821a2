"""Selection of context items under a token budget, per conversation.

items(conv_id, kind, item_id, cat, o1, o2, o3, o4, tokens, priority, truncated_tokens): `cat, o1..o4` is the position of
an item in its conversation (category first), used only to break priority ties: the newest goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions import text as T

TOKEN_BUDGET = 4000
ARTIFACT_TOKENS = 500
MESSAGE_WEIGHT, TOPIC_WEIGHT, ENTITY_WEIGHT, ARTIFACT_WEIGHT, GLOBAL_WEIGHT = 1.0, 3.0, 2.0, 2.5, 10.0
REQUEUE = 50.0
ORDER = ["cat", "o1", "o2", "o3", "o4"]


def _item(kind, item_id: Column, cat: int, order: list[Column], tokens: Column, priority: Column, cut: Column | None = None):
    places = [*order, *[F.lit(0)] * (4 - len(order))]
    return [
        "conv_id",
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        item_id.cast("string").alias("item_id"),
        F.lit(cat).alias("cat"),
        *[p.cast("bigint").alias(f"o{i + 1}") for i, p in enumerate(places)],
        tokens.cast("bigint").alias("tokens"),
        priority.cast("double").alias("priority"),
        (F.lit(None) if cut is None else cut).cast("bigint").alias("truncated_tokens"),
    ]


def summary_items(summaries: DataFrame) -> DataFrame:
    level = F.col("level")
    weight = (
        F.when(level == "message", MESSAGE_WEIGHT).when(level == "topic", TOPIC_WEIGHT).otherwise(GLOBAL_WEIGHT)
    )
    place = F.when(level == "message", 0).when(level == "topic", 1).otherwise(2)
    tokens = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(T.token_estimate(F.col("content")))
    item_id = F.concat_ws(":", level, F.col("first_turn").cast("string"), F.col("last_turn").cast("string"))
    return summaries.select(*_item(level, item_id, 0, [place, F.col("first_turn")], tokens, weight))


def entity_items(scored: DataFrame, relationships: DataFrame) -> DataFrame:
    """Cost of an entity: its name, aliases and the types of its outgoing relationships, joined by blanks."""
    typed = relationships.groupBy("conv_id", F.col("src").alias("low")).agg(
        F.sum(F.length("relationship") + 1).alias("type_chars")
    )
    joined = scored.join(typed, ["conv_id", "low"], "left")
    chars = (
        F.length("name")
        + F.aggregate("aliases", F.lit(0), lambda acc, a: acc + F.length(a) + 1)
        + F.coalesce("type_chars", F.lit(0))
    )
    tokens = F.greatest(F.lit(1), F.floor(chars / 4))
    rank = F.col("rank")
    # rank = (-mention count, first position): ascending is list order.
    order = [rank["n"], rank["at"]["turn"], rank["at"]["source"], rank["at"]["ix"]]
    return joined.select(
        *_item("entity", F.col("low"), 1, order, tokens, ENTITY_WEIGHT * (0.5 + F.col("importance")))
    )


def artifact_items(artifacts: DataFrame, max_tokens: int = ARTIFACT_TOKENS) -> DataFrame:
    """artifacts(conv_id, ix, title, content); the cost after truncation is known up front."""
    title = T.token_estimate(F.col("title"))
    full = T.token_estimate(F.col("content")) + title
    cut = T.token_estimate(T.truncate_artifact(F.col("content"), max_tokens)) + title
    return artifacts.select(
        *_item("artifact", F.col("ix"), 2, [F.col("ix")], full, F.lit(ARTIFACT_WEIGHT), F.when(full > max_tokens, cut))
    )


def protected_items(rows: DataFrame, kind: str, text: Column, ix: str) -> DataFrame:
    """Decisions and tasks count towards the total and are never dropped."""
    return rows.select(*_item(kind, F.col(ix), 3, [F.col(ix)], T.token_estimate(text), F.lit(GLOBAL_WEIGHT)))


def drop_bucket(priority: Column) -> Column:
    """Follows the order in which items go: priority, then newest first.

    The place of a message summary is (level, turn), of a topic (level, first turn), of an entity (count, turn), of the others
    (position): blocks of 1,024 turns or positions of equal priority are the most that one task puts in order.
    """
    block = lambda c: -F.floor(F.coalesce(F.col(c), F.lit(0)) / 1024)
    paired = F.col("cat") < 2
    first = F.when(paired, -F.col("o1")).otherwise(block("o1"))
    return F.struct(priority.alias("p"), (-F.col("cat")).alias("c"), first.alias("o1"), F.when(paired, block("o2")).otherwise(0).alias("o2"))


def select_within(items: DataFrame, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Add `dropped` and `final_tokens`.

    Dropping in priority order until the total fits is a running sum: an item goes iff the total minus everything dropped
    before it is still over budget.  An artifact has two turns: it is first truncated, and dropped when its time comes
    again fifty priority points later; one that truncation does not shrink is dropped at its first turn.  Only
    conversations over budget enter the ordered step, and there a conversation is cut into buckets along the order.
    """
    totals = items.groupBy("conv_id").agg(F.sum("tokens").alias("total"))
    over = totals.where(F.col("total") > budget)
    droppable = items.join(over, "conv_id").where(~F.col("kind").isin("global", "decision", "task"))
    saved_tokens = F.coalesce(F.col("tokens") - F.col("truncated_tokens"), F.lit(0))
    event = lambda priority, saving, action: F.struct(
        priority.alias("p"), saving.alias("saving"), F.lit(action).alias("action")
    )
    two_turns = F.array(
        event(F.col("priority"), saved_tokens, "truncate"),
        event(F.col("priority") + REQUEUE, F.col("truncated_tokens"), "drop"),
    )
    one_turn = F.array(event(F.col("priority"), F.col("tokens"), "drop"))
    events = droppable.select(
        "conv_id", "kind", "item_id", "total", *ORDER,
        F.explode(F.when(saved_tokens > 0, two_turns).otherwise(one_turn)).alias("e"),
    ).select("conv_id", "kind", "item_id", "total", *ORDER, "e.*")
    newest_first = [F.asc("p"), *[F.desc(c) for c in ORDER]]
    bucket = drop_bucket(F.col("p"))
    placed = ordered.running_sum(events, ["conv_id"], newest_first, F.col("saving"), bucket, "gone_before", inclusive=False)
    applied = placed.where(F.col("total") - F.col("gone_before") > budget)
    outcome = applied.groupBy("conv_id", "kind", "item_id").agg(
        F.bool_or(F.col("action") == "drop").alias("dropped"), F.sum("saving").alias("saved")
    )
    joined = items.join(outcome, ["conv_id", "kind", "item_id"], "left")
    return joined.withColumns(
        {
            "dropped": F.coalesce("dropped", F.lit(False)),
            "final_tokens": F.col("tokens") - F.coalesce("saved", F.lit(0)),
        }
    ).drop("saved")


def selection_stats(selected: DataFrame) -> DataFrame:
    """Tokens before and after, their ratio (1 when nothing had to go) and the number of dropped items."""
    summed = selected.groupBy("conv_id").agg(
        F.sum("tokens").alias("original_tokens"),
        F.sum("final_tokens").alias("total_tokens"),
        F.count_if("dropped").alias("items_dropped"),
    )
    ratio = F.when(F.col("original_tokens") > 0, F.col("total_tokens") / F.col("original_tokens")).otherwise(1.0)
    return summed.withColumn("compression_ratio", F.round(ratio, 4))


def generation_stats(
    conversations: DataFrame, messages: DataFrame, selected: DataFrame, relationships: DataFrame, topics: DataFrame
) -> DataFrame:
    """One row per conversation with the counts of its finished context."""
    kept = ~F.col("dropped")
    n = messages.groupBy("conv_id").agg(F.count("*").alias("message_count"))
    counts = selected.groupBy("conv_id").agg(
        F.count_if(kept & (F.col("kind") == "entity")).alias("entity_count"),
        F.count_if(kept & F.col("kind").isin("message", "topic", "global")).alias("summary_count"),
    )
    r = relationships.groupBy("conv_id").agg(F.count("*").alias("relationship_count"))
    t = topics.groupBy("conv_id").agg(F.count("*").alias("topic_count"))
    joined = conversations.select("conv_id", "source_format", "source_model", "source_llm")
    for part in (n, counts, r, t, selection_stats(selected).select("conv_id", "compression_ratio")):
        joined = joined.join(part, "conv_id", "left")
    zero = F.lit(0).cast("bigint")
    numbers = ["message_count", "entity_count", "summary_count", "relationship_count", "topic_count"]
    return joined.select(
        "conv_id", "source_format", "source_model", "source_llm", *[F.coalesce(c, zero).alias(c) for c in numbers],
        F.coalesce("compression_ratio", F.lit(1.0)).alias("compression_ratio"),
    )
