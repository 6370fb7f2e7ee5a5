"""Connected components of an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(node, comp): for every node of ``edges(a, b)`` the smallest node it is connected with.

    Each round every node takes the smallest label next to it and then the label of that label, so the number of
    rounds grows with the logarithm of a component's diameter. Labels and edges are stashed between rounds; hubs are
    handled by partial aggregation and by AQE's splitting of the join on the edge side.
    """
    both = stash.keep(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stash.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        step = stash.keep(
            labels.join(near, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp")), "step"
        )
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        after = stash.keep(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        moved = after.where("was <> comp").limit(1).count()
        stash.drop(step, labels)
        labels = after.select("node", "comp")
        if not moved:
            return labels
