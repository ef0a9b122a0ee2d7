"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import release, staged


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, longs); a component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shrink by halves. Rounds work on the
    links alone and are written to the shared folder, where a round's table
    goes when the next is there; nothing is collected.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = staged(both, "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy("a").agg(F.min("label").alias("_near"))
        )
        nearest = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jumped = staged(
            nearest.alias("x").join(labels.select(F.col("node").alias("_n"), F.col("label").alias("_jump")), F.col("label") == F.col("_n"), "left")
            .select("node", "_old", F.least("label", "_jump").alias("label")),
            "labels", labels,
        )
        if jumped.where("label != _old").isEmpty():
            release(both)
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped
