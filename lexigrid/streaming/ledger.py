"""The spending ledger as a stream: totals over appended files, and by window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def totals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of running totals by user over files that are appended below path."""
    return spark.readStream.schema(schema).parquet(path).groupBy("user_id").agg(F.count("*").alias("requests"), F.sum("value").alias("spent"))


def windowed(spark: SparkSession, path: str, schema: str, width: str, late: str) -> DataFrame:
    """Requests and spending by window of event time; rows later than the watermark are left out."""
    rows = spark.readStream.schema(schema).parquet(path).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("requests"), F.sum("value").alias("spent"))
