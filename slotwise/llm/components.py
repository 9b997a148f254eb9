"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node of ``edges`` (u, v).

    Each round takes the smallest label among a node and its neighbours and then
    the label of that label; labels are written to the shared folder every round.
    Only the count of changed labels reaches the driver.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialise(both.filter(F.col("u") != F.col("v")).distinct())
    labels = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        hop = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        moved = materialise(low.join(hop, "low", "left").select("node", F.least("low", F.coalesce("jump", "low")).alias("label"), "old"))
        changed = moved.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
