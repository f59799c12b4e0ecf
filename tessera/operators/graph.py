"""Connected components of an edge table by least labels, which are handed to the labels' own nodes, and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): root is the smallest node that can be reached. Every round is written to the shared folder."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        nearer = written(labels.join(least, labels.node == least.a, "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "nearer")
        hook = nearer.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("hook"))
        nearer = nearer.join(hook, "node", "left").select("node", "was", F.least("root", "hook").alias("root"))
        jump = nearer.select(F.col("node").alias("root"), F.col("root").alias("over"))
        moved = written(nearer.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("over", "root")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if not moved.filter("was <> root").limit(1).count():
            return labels
