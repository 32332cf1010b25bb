"""Where jobs put tables that cut lineage: below spark.checkpoint.dir, which the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local folder only where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read again: what follows does not compute it anew, and lost executors cost no more than a read."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
