"""Event counts over tumbling windows of a stream: an addition to the batch jobs, with event time and watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.operators.scratch import shared_folder

WINDOW, LATENESS = "1 day", "1 hour"


def windowed(events: DataFrame, window: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """(window_start, event_type, events) by event time; events later than the watermark are dropped."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), "event_type", "events")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table replayed as a stream until it is used up: closed windows, as the append sink got them."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    counts = windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    run = counts.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/out").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


#: Windows that end an hour before the last event are closed.
SQL = """SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events FROM events
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2"""
