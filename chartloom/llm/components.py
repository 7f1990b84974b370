"""Connected components by minimum labels and pointer jumping, as Spark joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chartloom.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in the edges ``(a, b)``: the smallest id reachable.

    Each round takes the least label among a node's neighbours (a partial aggregate, so a node with
    very many neighbours is no burden), then jumps to the label's own label. Rounds grow with the logarithm of the
    longest path. All joins are between written tables, so that adaptive execution can split hot keys.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        hooked = cut_lineage(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        # The label's own label is at most the label, and is reachable too.
        own = hooked.select(F.col("id").alias("component"), F.col("component").alias("m"))
        jumped = cut_lineage(hooked.join(own, "component").select("id", "old", F.col("m").alias("component")))
        if jumped.filter("component < old").isEmpty():
            return jumped.select("id", "component")
        labels = jumped.select("id", "component")
