"""Connected components of one large graph by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import saved


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids -> (node, root): every node of an edge with one id that stands for its component.

    Each round hooks every node to its least neighbour, follows that link once more, and replaces the ends of the edges by
    what they hang on; edges inside a component vanish.  A path shrinks to half in a round, a star to nothing.  Every
    round is written to the shared folder, so a lost executor costs one round.
    """
    edges = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        up = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "hooks")
        again = up.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        hang = saved(up.join(again, "p").select(F.col("a").alias("x"), F.col("pp").alias("y")), "hooks")
        moved = roots.join(hang, F.col("root") == F.col("x"), "left").select("node", F.coalesce("y", "root").alias("root"))
        roots = saved(moved, "roots")
        left = edges.join(hang, F.col("a") == F.col("x")).select(F.col("y").alias("a"), "b")
        left = left.join(hang, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
        edges = saved(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return roots
