"""Daily products: VWAP bands, signed ticks and CVD, as-of grids, volume clusters, opening ranges, liquidity sweeps.

All take bars or ticks of any number of symbols and days; windows are keyed by symbol, running totals by local date too.
Equal tick times are ordered by `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.calendar import SessionWindow, filter_session, floor_minute, in_session, local_time
from tickloom.functions.windows import Source, asof_join, change_totals, in_blocks, rolling, running_totals


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def direction(open_: str = "open", close: str = "close") -> Column:
    return F.signum(F.col(close) - F.col(open_)).cast("byte")


def vwap(bars: DataFrame) -> DataFrame:
    """vwap and sigma over all rows of a symbol so far; null until there is volume."""
    df = bars.withColumns({"_day": F.to_date("timestamp_cot"), "_pv": typical_price() * F.col("volume"), "_p2v": F.pow(typical_price(), F.lit(2)) * F.col("volume")})
    df = running_totals(df, {"_cv": F.col("volume"), "_cpv": F.col("_pv"), "_cp2v": F.col("_p2v")}, ["timestamp_utc"], "_day")
    df = df.withColumn("vwap", F.try_divide("_cpv", "_cv"))
    spread = F.try_divide("_cp2v", "_cv") - F.pow("vwap", F.lit(2))
    return df.withColumn("sigma", F.sqrt(F.greatest(spread, F.lit(0.0)))).drop("_day", "_pv", "_p2v", "_cv", "_cpv", "_cp2v")


def signed_ticks(ticks: DataFrame) -> DataFrame:
    """price, weight, side, delta and the running sum of delta (cvd)."""
    price = F.when(F.col("last") > 0, F.col("last")).otherwise((F.col("bid") + F.col("ask")) / 2)
    weight = F.when(F.col("volume_real") > 0, F.col("volume_real")).when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)
    df = ticks.withColumns({"price": price, "weight": weight, "_day": F.to_date("timestamp_cot")})
    traded = F.col("last") > 0

    def side(before: Column) -> Column:
        moved = F.coalesce(F.signum(F.col("price") - before), F.lit(0.0))
        return F.when(traded & (F.col("last") >= F.col("ask")), 1.0).when(traded & (F.col("last") <= F.col("bid")), -1.0).otherwise(moved)

    df = change_totals(df, "price", lambda before: side(before) * F.col("weight"), ["price", "weight", "last", "bid", "ask"], "cvd", ["timestamp_utc", "seq"], "_day")
    df = df.withColumn("side", side(F.col("_before"))).withColumn("delta", F.col("side") * F.col("weight"))
    return df.select(*[c for c in df.columns if c not in ("_day", "_before", "cvd")], "cvd")


def align_cvd(signed: DataFrame, bars: DataFrame) -> DataFrame:
    """The last cvd at or before each bar's open, 0 before the first tick."""
    grid = bars.select("symbol", "timestamp_utc")
    joined = asof_join(grid, "timestamp_utc", Source(signed, "timestamp_utc", ["cvd"], tie="seq"))
    return joined.withColumn("cvd", F.coalesce("cvd", F.lit(0.0)))


def fill_minutes(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """Bars for every step between the first and the last of a symbol; those that were missing are flat at the close before, without volume.

    The grid is laid out day by day, so that a long series is not one task.
    """
    step, day = F.expr(f"INTERVAL {minutes} MINUTES"), F.expr("INTERVAL 1 DAY")
    ends = bars.groupBy("symbol").agg(F.min("timestamp_utc").alias("_from"), F.max("timestamp_utc").alias("_to"))
    days = ends.select("symbol", "_to", F.explode(F.sequence("_from", "_to", day)).alias("_at")).repartition("symbol", "_at")
    last = F.least(F.col("_at") + day - step, F.col("_to"))
    grid = days.select("symbol", F.explode(F.sequence("_at", last, step)).alias("timestamp_utc"))
    prices = ("open", "high", "low", "close")
    known = bars.select("symbol", F.col("timestamp_utc").alias("_bar"), *prices, "volume", "spread", "real_volume")
    filled = asof_join(grid, "timestamp_utc", Source(known, "_bar", ["_bar", *prices, "volume", "spread", "real_volume"]))
    own = F.col("_bar") == F.col("timestamp_utc")
    kept = {c: F.when(own, F.col(c)).otherwise(F.col("close")) for c in prices[:3]} | {c: F.when(own, F.col(c)).otherwise(F.lit(0).cast(dict(bars.dtypes)[c])) for c in ("volume", "real_volume")}
    return filled.withColumns(kept).select("symbol", "timestamp_utc", local_time("timestamp_utc").alias("timestamp_cot"), *prices, "volume", "spread", "real_volume")


def direction_matrix(h1: DataFrame, m15: DataFrame, m1: DataFrame) -> DataFrame:
    """Directions of the bars of three timeframes on the finest grid, by open times, 0 where there is none."""
    grid = m1.select("symbol", "timestamp_utc", direction().alias("m1"))
    slower = [Source(frame.select("symbol", "timestamp_utc", direction().alias(name)), "timestamp_utc", [name]) for name, frame in (("m15", m15), ("h1", h1))]
    return asof_join(grid, "timestamp_utc", *slower).withColumns({c: F.coalesce(c, F.lit(0)).cast("byte") for c in ("m1", "m15", "h1")})


def volume_clusters(signed: DataFrame, session: SessionWindow, step: float = 0.5) -> DataFrame:
    """Volume and delta by price level, the minute of most volume, and the class of the level.

    The three largest levels are HVN, the two smallest of the rest LVN; equal volumes go to the lower level first.
    """
    t = filter_session(signed, session).withColumns({"level_index": F.rint(F.col("price") / step).cast("long"), "minute": floor_minute("timestamp_cot")})
    by_minute = t.groupBy("symbol", "level_index", "minute").agg(F.sum("weight").alias("w"), F.sum("delta").alias("d"))
    micros = F.unix_micros(F.col("minute").cast("timestamp"))
    levels = by_minute.groupBy("symbol", "level_index").agg(
        F.sum("w").alias("volume"), F.sum("d").alias("net_delta"), F.max_by("minute", F.struct("w", -micros)).alias("minute"))
    down = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("volume"), "level_index"))
    up = F.row_number().over(Window.partitionBy("symbol", F.col("_down") > 3).orderBy("volume", "level_index"))
    ranked = levels.withColumn("_down", down).withColumn("_up", up)
    kind = F.when(F.col("_down") <= 3, "HVN").when(F.col("_up") <= 2, "LVN").otherwise("Neutral")
    return ranked.select("symbol", "level_index", (F.col("level_index") * step).alias("level"), "volume", "net_delta", "minute", kind.alias("kind"))


def delta_by_minute(signed: DataFrame) -> DataFrame:
    return signed.groupBy("symbol", floor_minute("timestamp_utc").alias("minute_utc")).agg(F.sum("delta").alias("bar_delta"))


def opening_ranges(bars_with_vwap: DataFrame, session: SessionWindow, minutes: tuple[int, ...] = (15, 30)) -> DataFrame:
    """One row per symbol and range: extremes and their first times, later expansion, volume z-score, deviation from VWAP.

    Ranges start with the session of the first local date; one without bars gives no row.
    """
    bars = bars_with_vwap.where(in_session(session))
    start = F.to_date(F.min("timestamp_cot")).cast("timestamp_ntz") + F.expr(f"INTERVAL {0 if session.full_day else session.start} MINUTES")
    base = bars.groupBy("symbol").agg(start.alias("_start"), F.avg("volume").alias("_mean"), F.stddev_pop("volume").alias("_sd"))
    ranges = F.explode(F.array(*[F.struct(F.lit(m).alias("minutes"), F.expr(f"INTERVAL {m} MINUTES").alias("length")) for m in minutes]))
    rows = bars.join(base, "symbol").withColumn("_r", ranges).withColumn("_end", F.col("_start") + F.col("_r.length"))
    inside = (F.col("timestamp_cot") >= F.col("_start")) & (F.col("timestamp_cot") < F.col("_end"))
    later = F.col("timestamp_cot") >= F.col("_end")
    micros = F.unix_micros(F.col("timestamp_cot").cast("timestamp"))
    out = rows.groupBy("symbol", F.col("_r.minutes").alias("minutes")).agg(
        F.max(F.when(inside, F.col("high"))).alias("high"), F.min(F.when(inside, F.col("low"))).alias("low"),
        F.max_by("timestamp_cot", F.when(inside, F.struct("high", -micros))).alias("high_at"), F.min_by("timestamp_cot", F.when(inside, F.struct("low", micros))).alias("low_at"),
        F.max(F.when(later, F.col("high"))).alias("_hi"), F.min(F.when(later, F.col("low"))).alias("_lo"), F.avg(F.when(inside, F.col("volume"))).alias("_v"),
        F.coalesce(F.stddev_samp(F.when(inside, F.col("close") - F.col("vwap"))), F.lit(0.0)).alias("vwap_deviation"),
        F.first("_mean").alias("_mean"), F.first("_sd").alias("_sd"), F.count_if(inside).alias("_n"))
    z = F.when(F.col("_sd") > 0, (F.col("_v") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    expansion = F.greatest(F.col("_hi") - F.col("high"), F.col("low") - F.col("_lo"), F.lit(0.0))
    return out.where("_n > 0").select("symbol", "minutes", "high", "high_at", "low", "low_at", expansion.alias("expansion"), z.alias("volume_z"), "vwap_deviation")


def sweeps(bars: DataFrame, signed: DataFrame, session: SessionWindow, lookback: int = 5) -> DataFrame:
    """Bars that break a prior extreme, close back inside and whose delta is against the break.

    Windows begin at the session filter; a bar takes the delta of the last minute with ticks. The label follows the high
    alone, as a bar may break both extremes.
    """
    prior = lambda d, w: d.withColumns({"prior_high": rolling(F.max, F.col("high"), lookback, w, prior=True), "prior_low": rolling(F.min, F.col("low"), lookback, w, prior=True)})
    v = in_blocks(filter_session(bars, session), prior, lookback)
    v = asof_join(v, "timestamp_utc", Source(delta_by_minute(signed), "minute_utc", ["bar_delta"])).withColumn("bar_delta", F.coalesce("bar_delta", F.lit(0.0)))
    up = F.col("high") > F.col("prior_high")
    high = up & (F.col("close") < F.col("prior_high")) & (F.col("bar_delta") < 0)
    low = (F.col("low") < F.col("prior_low")) & (F.col("close") > F.col("prior_low")) & (F.col("bar_delta") > 0)
    return v.where(high | low).select("symbol", "timestamp_cot", F.when(up, "high").otherwise("low").alias("kind"), F.when(up, F.col("high")).otherwise(F.col("low")).alias("price"), F.abs("bar_delta").alias("divergence"))
