"""Walking parent or child pointers by pointer doubling.

A chain of length L is followed in log2(L) equi-joins instead of L: each round joins the walk found so far with a table
of jumps twice as long.  Every round is written to the shared folder, so the plan stays small and a lost executor costs
one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import saved


def walk(
    starts: DataFrame, links: DataFrame, keys: Sequence[str], max_steps: int | None = None
) -> DataFrame:
    """All nodes reached from each start: starts(keys, start), links(keys, node, next) -> (keys, start, node, step).

    A chain ends at a node without link, at `max_steps`, or where it would repeat a node (cycles stop there).
    """
    keys = list(keys)
    reached = saved(starts.select(*keys, "start", F.col("start").alias("node"), F.lit(0).alias("step")), "walk")
    jumps = saved(links.where(F.col("next").isNotNull()).select(*keys, "node", F.col("next").alias("to")), "jumps")
    span = 1
    while max_steps is None or span <= max_steps:
        ahead = (
            reached.join(jumps, [*keys, "node"])
            .select(*keys, "start", F.col("to").alias("node"), (F.col("step") + span).alias("step"))
        )
        if max_steps is not None:
            ahead = ahead.where(F.col("step") <= max_steps)
        both = reached.unionByName(ahead).groupBy(*keys, "start", "node").agg(F.min("step").alias("step"))
        grown = saved(both, "walk")
        if grown.count() == reached.count():
            break
        reached = grown
        further = jumps.select(*keys, "node", F.col("to").alias("mid")).join(
            jumps.select(*keys, F.col("node").alias("mid"), "to"), [*keys, "mid"]
        )
        jumps = saved(further.select(*keys, "node", "to"), "jumps")
        span *= 2
    return reached


def leads_to_cycle(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes whose chain of links never ends: links(keys, node, next) -> (keys, node)."""
    keys = list(keys)
    jumps = saved(links.where(F.col("next").isNotNull()).select(*keys, "node", F.col("next").alias("to")), "jumps")
    nodes = jumps.count()
    span, left = 1, nodes
    # After more steps than there are nodes only chains that run in a circle still have a successor.
    while span <= nodes and left > 0:
        further = jumps.select(*keys, "node", F.col("to").alias("mid")).join(
            jumps.select(*keys, F.col("node").alias("mid"), "to"), [*keys, "mid"]
        )
        jumps = saved(further.select(*keys, "node", "to"), "jumps")
        left = jumps.count()
        span *= 2
    return jumps.select(*keys, "node")
