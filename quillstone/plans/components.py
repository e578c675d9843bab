"""Connected components of graphs by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstone.plans.tables import materialize


def connected(edges: DataFrame) -> DataFrame:
    """``(id, label)`` of ``edges (a, b)``: the least id of each component.

    Labels travel along edges and jump to their label's label until none changes, so rounds grow with the logarithm of the diameter. Each round is a table in the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        far = labels.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        new = materialize(near.join(far, "mid").select("id", "old", F.least("mid", "far").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels
