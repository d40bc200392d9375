"""Connected components of a link table, with nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rounds double the reach of a label, so this covers any graph; running out is an error.
MAX_ROUNDS = 80


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the least node reachable, itself included.

    Each round gives a node the least label among its neighbours and itself,
    lets labels flow from a node to its label (hooking), and then jumps to the
    label's label.  All groups are minima, so hot nodes are pre-aggregated, and
    only (node, label) pairs are ever kept.  An empty table gives an empty one.
    """
    both = materialize(
        links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links"
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("component")
        ),
        "labels",
    )
    if labels.isEmpty():
        return labels
    for _ in range(MAX_ROUNDS):
        # label of the least neighbour
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(
            F.col("a").alias("node"), "component"
        )
        # hooking: the node that is my label learns what I learn
        low = near.union(labels).groupBy("node").agg(F.min("component").alias("component"))
        low = low.join(labels.select("node", F.col("component").alias("old")), "node")
        hook = low.where("component < old").select(F.col("old").alias("node"), "component")
        low = low.select("node", "component").union(hook).groupBy("node").agg(
            F.min("component").alias("component")
        )
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = low.join(jump, "component", "left").select(
            "node", F.coalesce("next", "component").alias("component")
        )
        new = materialize(new, "labels")
        moved = new.join(
            labels.select("node", F.col("component").alias("old")), "node"
        ).where("component <> old")
        settled = moved.isEmpty()
        discard(labels)
        if settled:
            discard(both)
            return new
        labels = new
    raise RuntimeError("labels did not settle")
