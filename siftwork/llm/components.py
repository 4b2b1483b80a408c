"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.ship import drop, durable


def connect(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): the smallest node that each can reach.

    Each round takes the smallest label among neighbours and then follows labels one step, so paths
    shorten fast. Rounds are written to the shared folder, where the last one stays; only the number of changes
    comes to the driver.
    An empty table gives an empty one.
    """
    both = links.select("a", "b").union(links.select("b", "a").toDF("a", "b"))
    edges = durable(both.where("a != b").distinct(), "links")
    last = labels = durable(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("label")),
        "labels",
    )
    while True:
        heard = edges.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node"))
        heard = heard.agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        nearer = durable(nearer, "labels")
        drop(last)
        jump = nearer.select(F.col("node").alias("next"), F.col("next").alias("far"))
        # a label is a node of its own component, so the join finds one row each
        step = nearer.join(jump, "next").select("node", F.col("label").alias("old"), F.col("far").alias("label"))
        last = step = durable(step, "labels")
        drop(nearer)
        if step.where("old != label").isEmpty():
            drop(edges)
            return step.select("node", F.col("label").alias("component"))
        labels = step.select("node", "label")
