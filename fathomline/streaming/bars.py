"""Bars from ticks; the same plan for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_bars(ticks: DataFrame, key: str, ts: str, price: str, qty: str | None = None, every: str = "15 minutes", watermark: str = "1 hour", by_time: str = "bar_time") -> DataFrame:
    """Open, high, low, close and volume of fixed intervals. Volume counts ticks where there is no quantity.

    Streams need a zoned event time: it is cast for the watermark, and back in the result.
    """
    kind = dict(ticks.dtypes)[ts]
    if ticks.isStreaming:
        ticks = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    volume = F.sum(qty) if qty else F.count("*")
    grouped = ticks.groupBy(key, F.window(ts, every).alias("__w")).agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), volume.cast("double").alias("volume"))
    return grouped.select(key, F.col("__w.start").cast(kind).alias(by_time), "open", "high", "low", "close", "volume")
