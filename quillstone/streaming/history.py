"""Streams of corrections into an append-only history (an extension; batches give the same result)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions.temporal import close_chain


def append_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append versions ``(fact_id, known_from, ...)`` as they come, in a folder for each batch: one that runs again overwrites its own only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The history, each version closed by the next of its key."""
    return close_chain(spark.read.parquet(path), key, order)
