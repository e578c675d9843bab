"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstone.operators.lexical import top

K = 1


def fuse(signals: DataFrame, k: int = K, top_k: int = 10, weights: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score, contributions, rank0)`` of ``signals (query_id, signal, rank0, doc_id)``; ``weights (signal, w)``, 1 where missing."""
    s = signals.join(weights, "signal", "left").withColumn("w", F.coalesce("w", F.lit(1.0))) if weights is not None else signals.withColumn("w", F.lit(1.0))
    s = s.withColumn("c", F.col("w") / (k + F.col("rank0")))
    each = F.array_sort(F.collect_list(F.struct("signal", F.col("rank0").alias("rank"), F.col("c").alias("contribution"))))
    out = s.groupBy("query_id", "doc_id").agg(each.alias("contributions"))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["contribution"])  # in a fixed order, so that sums don't vary
    return top(out.withColumn("score", total), top_k)
