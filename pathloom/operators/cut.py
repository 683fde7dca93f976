"""Short lineage for results that many later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that driver and executors share (spark.checkpoint.dir), read back.

    One computation, where a checkpoint takes two; columns stay prunable, and lost executors lose nothing. The
    files go when the driver ends. Where the setting is unset, a local master gets a folder of its own; a
    cluster gets an error, as its executors would each write to their own disks.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(where or 'file:///tmp/checkpoints').rstrip('/')}/pathloom-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
