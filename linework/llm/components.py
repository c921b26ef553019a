"""Connected components of a graph held in tables: smallest-neighbour labels with pointer jumping, no driver state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so that chains
    shorten by half; it ends when no label changes. An empty table gives no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = stored(both, "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = stored(step.join(up, "label", "left").select("node", "old", F.least("label", "jump").alias("label")), "labels")
        if step.where("old <> label").isEmpty():
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
