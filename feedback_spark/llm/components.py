"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedback_spark.llm.frames import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long): the least node of its component.

    Each round takes the least label among a node's neighbours and then follows that label's own label, so
    that the distance to the least node halves. Rounds are written to the shared folder, which cuts lineage.
    Only the number of changed nodes comes to the driver. No table gives a node's neighbours as one row, and
    the least label of a node with many neighbours is found in parts before the parts meet.
    """
    both = edges.filter(F.col("a") != F.col("b"))
    both = durable(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
                     .select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jumped"))
        moved = durable(lower.join(jump, "next").select("node", "label", F.least("next", "jumped").alias("moved")), "labels")
        changed = moved.filter(F.col("label") != F.col("moved")).limit(1).count()
        labels = moved.select("node", F.col("moved").alias("label"))
        if not changed:
            return labels
