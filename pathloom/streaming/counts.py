"""Statistics kept up to date as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n, total): counts in tumbling windows; rows later than the watermark are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy("user_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", "total")
