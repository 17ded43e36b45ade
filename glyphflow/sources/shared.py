"""The folder that driver and executors share, and stores as Spark's file system client sees them."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Only in local mode (tests), and where it is unset, a temporary folder is
    set for the life of the session; on a cluster its absence is an error, as
    executors don't share the driver's disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="glyphflow-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def store(spark: SparkSession, path: str):
    """The path and its file system, as objects of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
