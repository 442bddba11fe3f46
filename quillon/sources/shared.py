"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``. Where it is unset, as in tests: a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "quillon-shared")).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in that folder that nothing has."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, the same for all who read it, and not lost with an executor."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path), for renaming and deleting."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
