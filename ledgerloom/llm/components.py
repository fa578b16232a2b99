"""Connected components of a link table, without gathering links or members anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every end of ``links`` (columns ``a``, ``b``, of one
    ordered type): the label is the smallest node reachable.

    Each round every node takes the smallest label among itself and its neighbours,
    then the label of that label; rounds end when nothing changes. Rounds are written
    to the shared folder, so a lost executor costs one round at most.
    """
    both = settled(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = moved.select(F.col("node").alias("_to"), F.col("label").alias("_further"))
        moved = settled(moved.join(jump, moved["label"] == jump["_to"], "left").select(
            "node", "old", F.least("label", F.coalesce("_further", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("old <> label").head(1):
            return labels
