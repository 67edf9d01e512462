"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (node, node).

    Each round every node that has a smaller neighbour points to its smallest one, pointers are followed, and edges
    move to the ends of the pointers. Edges shrink each round; what is left is written to shared storage, never held by
    the driver.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    left = written(left.distinct(), "edges")
    labels = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    labels = written(labels, "labels")
    left = left.where("a <> b")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a").select(F.col("a").alias("v"), "p"), "up")
        for _ in range(2):
            on = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = up.join(on, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        up = written(up, "up")
        for c in ("a", "b"):
            to = up.select(F.col("v").alias(c), F.col("p").alias("to"))
            left = left.join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        left = written(left.where("a <> b").distinct(), "edges")
        to = up.select(F.col("v").alias("component"), "p")
        labels = written(labels.join(to, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
    return labels
