"""Connected components of an edge table, by labels that flow and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the smallest node that links reach) of every node with an edge (u, v).

    Each round takes the least label among neighbours and then the label of
    that label, so that long chains shorten by halves. Rounds end when no label
    changes; each is written, so that a lost executor costs one round at most.
    """
    both = edges.select("u", "v").where("u <> v")
    both = scratch.write(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy("u").agg(F.min("l").alias("l"))
        low = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        low = scratch.write(low, "low")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = scratch.write(low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("to", "label")).alias("label")), "labels")
        changed = not new.where("old <> label").isEmpty()
        labels = new
        if not changed:
            scratch.drop(both)
            return labels.select("node", "label")
