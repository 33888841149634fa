"""Closed-month products: anchored VWAP and CVD proxy, volume profile, daily bars with ATR, levels, sweeps, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions.calendar import Period, weekdays_only
from tickloom.functions.windows import rolling, running_totals, series
from tickloom.operators.intraday import typical_price

BINS = 120
LEAST_STEP = 0.01


def anchored(bars: DataFrame) -> DataFrame:
    """avwap (the typical price while there is no volume) and cvd_proxy (direction times volume) since the first row."""
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(0.0))
    df = bars.withColumns({"date": F.to_date("timestamp_cot"), "typical_price": typical_price(), "delta_proxy": F.signum(F.col("close") - F.col("open")) * volume, "_v": volume})
    df = running_totals(df, {"_cv": F.col("_v"), "_cpv": F.col("typical_price") * F.col("_v"), "cvd_proxy": F.col("delta_proxy")}, ["timestamp_utc"], "date")
    return df.withColumn("avwap", F.when(F.col("_cv") > 0, F.col("_cpv") / F.col("_cv")).otherwise(F.col("typical_price"))).drop("_v", "_cv", "_cpv")


def volume_profile(bars: DataFrame) -> DataFrame:
    """Volume by price level (of 1/120 of the range, 0.01 at least) and whether the level is the point of control."""
    step = F.greatest((F.max("high") - F.min("low")) / BINS, F.lit(LEAST_STEP))
    steps = bars.groupBy("symbol").agg(step.alias("step"))
    levels = (bars.join(steps, "symbol").groupBy("symbol", "step", F.rint(typical_price() / F.col("step")).cast("long").alias("level_index"))
              .agg(F.coalesce(F.sum(F.col("volume").cast("double")), F.lit(0.0)).alias("volume")))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "level_index")) == 1
    return levels.select("symbol", "level_index", (F.col("level_index") * F.col("step")).alias("level"), "volume", first.alias("is_poc"))


def daily_bars(bars: DataFrame) -> DataFrame:
    """Local-date OHLCV with true range, ATR over up to 14 days, and the range in ATRs."""
    at = F.col("timestamp_utc")
    days = bars.groupBy("symbol", F.to_date("timestamp_cot").alias("date")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.coalesce(F.sum(F.col("volume").cast("double")), F.lit(0.0)).alias("volume"), F.count("*").alias("bars"))
    w = series("date")
    days = days.withColumn("_before", F.lag("close").over(w))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))
    days = days.withColumn("true_range", true_range).withColumn("atr14", rolling(F.avg, F.col("true_range"), 14, w, least=1))
    return days.withColumn("expansion_atr", F.coalesce(F.try_divide(F.col("high") - F.col("low"), F.col("atr14")), F.lit(0.0))).drop("_before")


def macro_levels(bars: DataFrame) -> DataFrame:
    """Rows (symbol, level, price): open, high, low, close, poc and the final avwap."""
    at = F.col("timestamp_utc")
    a = anchored(bars).groupBy("symbol").agg(F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.max_by("avwap", at).alias("avwap"))
    poc = volume_profile(bars).where("is_poc").select("symbol", F.col("level").alias("poc"))
    return a.join(poc, "symbol").unpivot("symbol", ["open", "high", "low", "close", "poc", "avwap"], "level", "price")


def daily_sweeps(bars: DataFrame) -> DataFrame:
    """Days that break the extreme of all days before and close back inside; the label follows the high alone."""
    before = series("date").rowsBetween(Window.unboundedPreceding, -1)
    d = daily_bars(bars).withColumns({"prior_high": F.max("high").over(before), "prior_low": F.min("low").over(before)})
    up = F.col("high") > F.col("prior_high")
    hit = (up & (F.col("close") < F.col("prior_high"))) | ((F.col("low") < F.col("prior_low")) & (F.col("close") > F.col("prior_low")))
    return d.where(hit).select("symbol", "date", F.when(up, "high").otherwise("low").alias("kind"), F.when(up, F.col("high")).otherwise(F.col("low")).alias("price"), "close")


def coverage(bars: DataFrame, period: Period) -> DataFrame:
    """Of the period's Mondays to Fridays: local days with bars, rows, time range, and the days as a share of all."""
    expected, day = max(period.business_days(), 1), F.to_date("timestamp_cot")
    found = weekdays_only(bars.where((day >= F.lit(period.start)) & (day < F.lit(period.end)))).groupBy("symbol").agg(F.countDistinct(F.to_date("timestamp_cot")).alias("days"), F.count("*").alias("rows"), F.min("timestamp_cot").alias("first"), F.max("timestamp_cot").alias("last"))
    return found.withColumn("share", 100.0 * F.col("days") / expected)


def last_sweeps(bars: DataFrame, n: int = 10) -> DataFrame:
    """The last n daily sweeps of each symbol, as the report shows them."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return daily_sweeps(bars).withColumn("_n", newest).where(F.col("_n") <= n).drop("_n")
