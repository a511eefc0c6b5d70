"""The folder that the driver and all executors share, and tables written there to cut a job's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder in local mode; a cluster must name one, as its machines share no temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage and keeps the columns compressed."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked(small: DataFrame, what: str, most: int = 100_000) -> DataFrame:
    """A side of a join, stored and counted: broadcast up to `most` rows, else left to a shuffle."""
    rows = stored(small, what)
    return F.broadcast(rows) if rows.count() <= most else rows
