"""Preference formatting: one prompt from the common turns of a chosen and a rejected conversation, two masked completions.

Built-in functions only.  A rendering is cut into parts of at most `part_turns` turns, so a conversation of any length is
never gathered into one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = ("pair_id", "turn", "role", "text")


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def body(text: Column) -> Column:
    """The text of a turn with its end mark; a mark inside a text is broken up, so that texts cannot open turns."""
    return F.concat(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))


def aligned(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, turn, c, r, split): both sides of each turn, and the first turn in which they differ (null: nowhere)."""
    side = lambda df, name: df.select("pair_id", "turn", F.lit(name).alias("s"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    both = side(chosen, "c").unionByName(side(rejected, "r"))
    turns = both.groupBy("pair_id", "turn").agg(*[F.min(F.when(F.col("s") == s, F.col("m"))).alias(s) for s in "cr"])
    splits = turns.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("split"))
    on = splits.withColumnRenamed("pair_id", "__pair")
    return turns.join(on, F.col("pair_id").eqNullSafe(F.col("__pair"))).drop("__pair")


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, part_turns: int = 1_000, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """(pair_id, side, part, n_turns, body, mask) from two tables (pair_id, turn, role, text).

    side `prompt` holds the longest common turn prefix, once; `chosen` and `rejected` hold what follows on each side.  Turns
    are ordered by number; part = turn div part_turns; the parts of a side, in order, concatenate to its rendering.  mask
    is run-length coded: (length, loss) in characters; the loss is taken on the texts and end marks of completions by
    `loss_roles`, never on the prompt or on role marks.

    Null roles and texts count as empty.  Rows with the same (pair_id, turn) on one side count once (the least role, then
    text); rows without a turn are not part of a conversation and are left out; a null pair_id is a pair of its own.  A pair
    with equal sides has a prompt only; a pair that is missing on one side has the other's completion and no prompt.
    Other columns are ignored.
    """
    keep = lambda df: df.select(*TURNS).where(F.col("turn").isNotNull())
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    piece = lambda name, m, when: F.when(when & m.isNotNull(), F.struct(F.lit(name).alias("side"), m.alias("m")))
    rows = aligned(keep(chosen), keep(rejected)).select(
        "pair_id",
        "turn",
        F.inline(
            F.filter(
                F.array(
                    piece("prompt", F.col("c"), common),
                    piece("chosen", F.col("c"), ~common),
                    piece("rejected", F.col("r"), ~common),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    )
    opening, content = head(F.col("m.role")), body(F.col("m.text"))
    loss = (F.col("side") != "prompt") & F.col("m.role").isin(*loss_roles)
    rendered = rows.select(
        "pair_id",
        "side",
        F.floor(F.col("turn") / part_turns).cast("bigint").alias("part"),
        F.struct("turn", F.concat(opening, content).alias("s"), F.length(opening).alias("h"), F.length(content).alias("t"), loss.alias("loss")).alias("x"),
    )
    parts = rendered.groupBy("pair_id", "side", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    segment = lambda n, on: F.struct(n.alias("length"), on.alias("loss"))
    return parts.select(
        "pair_id",
        "side",
        "part",
        F.size("xs").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("xs", lambda x: x["s"]), "").alias("body"),
        F.flatten(F.transform("xs", lambda x: F.array(segment(x["h"], F.lit(False)), segment(x["t"], x["loss"])))).alias("mask"),
    )


def replies_of_the_next(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations (conv_id, turn, role, text).

    chosen: the conversation.  rejected: its turns before the last assistant turn, then the last assistant turn of the next
    conversation (conv_id + 1), where there is one.  A conversation without assistant turns is its own rejected side.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    last = turns.groupBy("pair_id").agg(F.max(reply).alias("reply"))
    cut = turns.join(last.select("pair_id", F.col("reply.turn").alias("at")), "pair_id", "left")
    kept = cut.where(F.col("at").isNull() | (F.col("turn") < F.col("at"))).drop("at")
    nearby = last.where(F.col("reply").isNotNull()).select((F.col("pair_id") - 1).alias("pair_id"), F.col("reply.text").alias("text"))
    foreign = last.where(F.col("reply").isNotNull()).join(nearby, "pair_id")
    foreign = foreign.select("pair_id", F.col("reply.turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return turns, kept.unionByName(foreign)
