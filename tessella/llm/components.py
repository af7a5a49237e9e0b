"""Connected components of an edge table, by smallest labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any ordered type to (node, label): label is the smallest node of the node's component.

    Each round gives every node the smallest label among itself, its neighbours and its label's label. A hub's edges
    meet its label in a join of two written tables, which Spark splits; minima are taken before the shuffle.
    No edges give no rows; edges from a node to itself and repeated edges change nothing; nulls are left out.
    """
    edges = edges.where("u is not null and v is not null")
    both = cut(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        far = both.join(labels, F.col("v") == F.col("node")).select(F.col("u").alias("node"), "label")
        near = cut(far.union(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        jump = near.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        new = cut(near.join(jump, F.col("label") == F.col("_at"), "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "_was"), "node").where("label <> _was").limit(1).count()
        labels = new
        if not changed:
            return labels
