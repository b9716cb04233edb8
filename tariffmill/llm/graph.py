"""Connected components by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.common import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "labels") -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b: long): label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours, then the label's own label, which halves the depth of
    long chains. Rounds read and write tables in the shared folder; only a count of changes reaches the driver. Minima
    are combined before the exchange, so a hub of any degree costs its task one row.
    """
    both = work.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-links")
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    done = 0
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = lower.join(jump, lower["next"] == jump["at"]).select("node", F.least("next", "beyond").alias("label"), F.col("label").alias("was"))
        step = work.save(moved, f"{name}-{done + 1}")
        changed = step.where("label < was").limit(1).count()
        work.drop(f"{name}-{done}")
        labels, done = step.select("node", "label"), done + 1
        if not changed:
            work.drop(f"{name}-links")
            return labels
