"""Folders that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def top(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session on one machine that has none gets one below its warehouse, elsewhere that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new(spark: SparkSession, name: str = "") -> str:
    """A path below it that is not in use, and goes when the session's process ends."""
    path = f"{top(spark)}/{uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/{name}" if name else path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or a folder, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
