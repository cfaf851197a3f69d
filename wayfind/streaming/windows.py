"""Event-time windows and watermarked distinct, the same code for batch and streams.

These are capabilities of the engine over the event log; the original model has
no event-time windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, watermark: str | None) -> DataFrame:
    """Watermarks need a zoned timestamp; logs without zone are UTC."""
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return zoned.withWatermark("ts", watermark) if watermark else zoned


def tumbling(events: DataFrame, width: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    grouped = _timed(events, watermark).groupBy(F.window("ts", width).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        *keys, F.col("w.start").alias("start"), "n", "total"
    )


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    grouped = _timed(events, watermark).groupBy(F.window("ts", width, slide).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, keys: list[str], watermark: str | None = None) -> DataFrame:
    grouped = _timed(events, watermark).groupBy(F.session_window("ts", gap).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """Drops repeated deliveries of an event within the watermark."""
    return _timed(events, watermark).dropDuplicatesWithinWatermark(keys)
