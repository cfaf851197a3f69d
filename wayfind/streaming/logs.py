"""Streams over the event and outcome logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfind.operators import quality


def start_counts(
    events: DataFrame, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = "15 seconds"
) -> StreamingQuery:
    """Incremental counts per key, refreshed at an interval (or once over what is there)."""
    counted = events.withColumn("mode", quality.event_mode()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence_sum"), F.count("confidence").alias("confidence_n")
    )
    writer = counted.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def start_month_log(events: DataFrame, folder: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Copies a stream into month partitions."""
    dated = events.withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    writer = dated.writeStream.format("parquet").partitionBy("year", "month").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
