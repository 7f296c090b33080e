"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder of setCheckpointDir; only a local master gets one of its own where neither is set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-docloom-"))
    return context.getCheckpointDir()


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table as written and read again: computed once, with no lineage, and there when an executor is lost."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
