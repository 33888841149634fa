"""Bars, ticks and observations made of the generic `events` and `orders` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.calendar import local_time, minutes_after

SYMBOL = "SYN"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(events: DataFrame) -> DataFrame:
    return events.select("event_id", "ts", "event_type", "value", (F.lit(100.0) + F.col("value")).alias("px"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))


def bars(events: DataFrame, minutes: int) -> DataFrame:
    at = F.struct("ts", "event_id")
    grouped = _priced(events).groupBy(F.window("ts", f"{minutes} minutes").start.alias("timestamp_utc")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
        F.count("*").alias("volume"), F.lit(20).alias("spread"), F.sum("k").alias("real_volume"))
    return grouped.select(F.lit(SYMBOL).alias("symbol"), "timestamp_utc", local_time("timestamp_utc").alias("timestamp_cot"), "open", "high", "low", "close", "volume", "spread", "real_volume")


def ticks(events: DataFrame) -> DataFrame:
    bid = F.col("px")
    kind = F.col("event_type")
    return _priced(events).select(
        F.lit(SYMBOL).alias("symbol"), F.col("ts").alias("timestamp_utc"), local_time("ts").alias("timestamp_cot"), bid.alias("bid"), (bid + 0.5).alias("ask"),
        F.when(kind == "purchase", bid + 0.5).when(kind == "error", bid).otherwise(0.0).alias("last"), F.col("k").cast("double").alias("volume"),
        F.when(kind == "signup", F.col("value")).otherwise(0.0).alias("volume_real"), F.col("event_id").alias("seq"))


def observations(orders: DataFrame) -> DataFrame:
    """Multi-month observations with a binary target, a synthetic probability and a session code."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return orders.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("observation_id"), F.col("o_orderkey").alias("key"), at.alias("observation_time_utc"),
        minutes_after(at, 60).alias("target_horizon_end_utc"), F.to_date(at).alias("session_date"), F.substring("o_orderpriority", 1, 1).alias("session_code"),
        (F.pmod(F.col("o_custkey"), F.lit(12)) * 15).alias("minute_of_session"), (F.col("o_totalprice") >= 250000).cast("int").alias("target_peak_075_atr"),
        (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 1000).alias("model_probability"), (F.pmod(F.col("o_custkey") * 104729, F.lit(1000)) / 1000).alias("baseline_probability"))
