"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. On one machine, where the session names none, a local one is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not d and held.isDefined():
        d = held.get()
    if not d:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quillstone-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not again if an executor is lost. The folder's owner removes it."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
