"""Streaming ingestion: duplicates inside the watermark go, windows are counted once late rows can't come any more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counts = stream.withWatermark(time, late).groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), kind, "n")
