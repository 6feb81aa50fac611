"""Connected components of an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hybridq.plans.stages import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for every node of `edges` (u, v: long).

    Each round takes the smallest label among neighbours and then the label of that
    label, so the rounds grow with the logarithm of the longest chain.  Rounds are written
    to the shared folder.
    """
    both = materialise(
        edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(),
        "edges",
    )
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
    labels = materialise(labels, "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        following = low.join(jump, "label", "left").select("node", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old")
        following = materialise(following, "labels")
        labels = following.select("node", "label")
        if following.where("label <> old").isEmpty():
            return labels
