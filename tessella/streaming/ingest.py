"""Structured Streaming extension: decisions arrive as files, repeats are dropped, cells are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decision_stream(spark: SparkSession, path: str, schema, delay: str = "1 hour") -> DataFrame:
    s = spark.readStream.schema(schema).parquet(path)
    return s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed_actions(stream: DataFrame, width: str = "1 day") -> DataFrame:
    return stream.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
