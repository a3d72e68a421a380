"""Bars from a stream of events, and returns of each series as its bars close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, hours: int = 4, late: str = "1 hour") -> DataFrame:
    """events (series_id, ts timestamp, value, event_id), a stream -> series_id, ts, typical_price; events later than `late` are left out."""
    price = (F.max("value") + F.min("value") + F.max_by("value", F.struct("ts", "event_id"))) / 3
    bars = events.withWatermark("ts", late).groupBy("series_id", F.window("ts", f"{hours} hours").alias("w")).agg(price.alias("typical_price"))
    return bars.select("series_id", F.col("w.start").alias("ts"), "typical_price")


def write_bars(bars: DataFrame, path: str, checkpoint: str):
    """Closed bars are appended as Parquet; all that there is now is read, then the query ends."""
    return bars.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
