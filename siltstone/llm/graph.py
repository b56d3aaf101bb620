"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import drop, table


def components(edges: DataFrame) -> DataFrame:
    """id, component_id (smallest id reachable) of every id in ``edges`` (a, b), which are links in either direction.

    Each round takes the smallest label among a vertex, its neighbours, and the vertex that its label names, so that
    paths shorten by more than half; rounds end when no label changes.  Labels live in tables in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = table(both, "links")
    labels = table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "id", "left").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        after = table(nearer.join(jump, "label", "left").select("id", "was", F.least("label", "beyond").alias("label")), "labels")
        same = after.where("was <> label").limit(1).count() == 0
        drop(labels)
        labels = after.select("id", "label")
        labels._siltstone_path = after._siltstone_path
        if same:
            drop(both)
            return labels.withColumnRenamed("label", "component_id")
