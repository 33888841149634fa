"""Streaming ticks to bars: event-time windows with a watermark (an addition to the batch products)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.calendar import local_time


def tick_bars(ticks: DataFrame, minutes: int = 1, late: str = "5 minutes") -> DataFrame:
    """OHLC bars of mid prices by symbol. ticks: symbol, timestamp (LTZ), bid, ask, volume, seq; works on batches too."""
    at, mid = F.struct("timestamp", "seq"), (F.col("bid") + F.col("ask")) / 2
    rows = ticks.withColumn("mid", mid).withWatermark("timestamp", late)
    grouped = rows.groupBy("symbol", F.window("timestamp", f"{minutes} minutes")).agg(
        F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.count("*").alias("volume"))
    start = F.col("window.start").cast("timestamp_ntz")
    return grouped.select("symbol", start.alias("timestamp_utc"), local_time(start).alias("timestamp_cot"), "open", "high", "low", "close", "volume")
