"""The batch functions of the item model over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Tumbling counts by event type, batch or stream; a stream drops what is later than ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n")


def first_copies(items: DataFrame, key: str, clock: str, late: str = "1 day") -> DataFrame:
    """One row per key; a stream remembers keys within the watermark only."""
    if items.isStreaming:
        return items.withWatermark(clock, late).dropDuplicatesWithinWatermark([key])
    return items.dropDuplicates([key])


def append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """foreachBatch sink that can be repeated: a batch owns its folder."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
