"""Connected components of an edge table, by the smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of every node in edges (a, b; of one type with an order, not null).

    Loops and repeated edges are fine; without edges the result is empty. Each step takes the smallest
    label next to a node, then the label of that label, so the steps needed grow with the logarithm of
    a component's width; each is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = stored(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        jump = new.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = stored(new.join(jump, new["label"] == jump["at"]).select("node", F.least("to", "label").alias("label"), "was"), "labels")
        if new.where("label < was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
