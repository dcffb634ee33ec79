"""Connected components by least labels and pointer jumping, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge list (its first two columns), component being the least node.

    Each round gives a node the least label around it and then its label's label, so
    rounds grow with the logarithm of a component's width. Minima are summed up before
    each exchange; a node with very many edges is one key of a splittable join.
    """
    u, v = edges.columns[:2]
    both = edges.select(F.col(u).alias("node"), F.col(v).alias("other")).where("node <> other")
    both = cut(both.union(both.select("other", "node")).distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        other = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        around = both.join(other, "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("far"))
        moved = cut(step.join(jump, "label", "left").select("node", "before", F.least("label", F.coalesce("far", "label")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> before").isEmpty():
            return labels
