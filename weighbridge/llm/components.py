"""Connected components of a table of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``: the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then that label's own
    label, so chains shorten by more than half; a round writes one table of nodes. Labels
    combine before the shuffle, so a hub costs no more than its number of map tasks.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.filter("a != b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                    .select("node", F.least("node", "low").alias("component")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("low")))
        next_ = labels.join(near, "node").select("node", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = settle(next_.join(up, "component").select("node", F.least("component", "above").alias("component"), "old"))
        labels = moved.select("node", "component")
        if moved.filter("component != old").isEmpty():
            return labels
