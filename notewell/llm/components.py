"""Connected components of an edge table, by minimum labels and pointer jumping on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); label is the smallest node it reaches.

    Each round takes the smallest label around every node, then the label of that label, so long
    chains shrink at least by half; rounds are written tables. No node's edges are gathered:
    minima combine before the shuffle and frequent nodes are split by the adaptive join.
    """
    both = space.save(edges.select("a", "b").where("a <> b").union(edges.select("b", "a").where("a <> b")).distinct(), f"{name}-edges")
    labels = space.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("least"))
        lowered = labels.join(around, F.col("node") == F.col("of")).select("node", F.least("label", "least").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = lowered.join(jump, F.col("next") == F.col("at"), "left").select("node", F.least("next", "beyond").alias("label"), "was")
        made = space.save(moved, f"{name}-{turn}")
        changed = made.where("label <> was").limit(1).count()
        labels = made.select("node", "label")
        if turn > 1:
            space.drop(f"{name}-{turn - 2}")
        if not changed:
            space.drop(f"{name}-edges", f"{name}-{turn - 1}")
            return labels
