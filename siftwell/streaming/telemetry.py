"""Telemetry as a stream: windowed counts of search log records, late ones within a watermark included.

An extension: the batch queries give the same figures from tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream over a folder of JSON lines."""
    return spark.readStream.schema(schema).json(folder)


def windowed_counts(events: DataFrame, label: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, label, n, total) for each window, from a stream or a table with ts."""
    held = events.withWatermark("ts", late)
    grouped = held.groupBy(F.window("ts", width).alias("w"), F.col(label).alias("label"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), "label", "n", "total")
