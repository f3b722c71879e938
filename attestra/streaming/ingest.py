"""Structured Streaming ingest: windowed counts over events, the same plan for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURLY_SQL = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) n, round(sum(value), 6) total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, event_type, n, total; rows later than the watermark are dropped in a stream, none in a batch."""
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


def hourly_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))


def hourly_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, late: str = "2 hours"):
    """Reads what arrives in ``folder`` once and appends closed windows to ``out``."""
    events = spark.readStream.schema(schema).parquet(folder)
    return hourly(events, late).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
