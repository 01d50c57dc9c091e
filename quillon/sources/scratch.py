"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder and all its tasks run in the driver's process.
LOCAL = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """A new folder below the one named by spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL
    return f"{base.rstrip('/')}/quillon/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that lineage ends there."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quillon_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables made by cut() that nothing still to be computed reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._quillon_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
