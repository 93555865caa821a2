"""Connected components of many small graphs at once, by spreading the smallest label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import saved


def connected(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """edges(keys, a, b) -> (keys, node, component); every node takes the smallest name it is connected to.

    Each round is one equi-join and one aggregate over narrow rows, written to the shared folder; the number of rounds is
    bounded by the diameter, which is small because containment is transitive.
    """
    keys = list(keys)
    both = edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(
        edges.select(*keys, F.col("b").alias("node"), F.col("a").alias("peer"))
    )
    links = saved(both.distinct(), "links")
    labels = saved(links.groupBy(*keys, "node").agg(F.least(F.min("peer"), F.col("node")).alias("component")), "labels")
    while True:
        heard = (
            links.join(labels.select(*keys, F.col("node").alias("peer"), "component"), [*keys, "peer"])
            .groupBy(*keys, "node")
            .agg(F.min("component").alias("heard"))
        )
        stepped = labels.join(heard, [*keys, "node"]).select(
            *keys, "node", F.least("component", "heard").alias("component"), (F.col("heard") < F.col("component")).alias("moved")
        )
        stepped = saved(stepped, "labels")
        labels = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return labels
