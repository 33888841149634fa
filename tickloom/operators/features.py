"""Causal features of observation bars. History windows come before the session filter, the session VWAP after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tickloom.contracts import ExperimentConfig
from tickloom.functions.calendar import SessionWindow, add_time_features, filter_observations, minutes_after
from tickloom.functions.windows import Source, asof_join, in_blocks, ratio, rolling, series
from tickloom.operators.intraday import direction, typical_price
from tickloom.operators.quality import checked_bars

EPSILON = 1e-12
RETURN_ROWS = 17  # 16 returns, each with the bar before
HISTORY_ROWS = 33  # the longest of the fixed windows, with the bar before
#: The model's inputs in their order.
MODEL_FEATURES = (
    "body_to_range", "close_location", "candle_direction", "return_15m", "return_30m", "return_60m", "realized_vol_60m", "realized_vol_4h",
    "direction_balance_60m", "atr", "range_atr", "body_atr", "volume_ratio", "volume_zscore", "real_to_tick_volume", "distance_daily_vwap_atr",
    "daily_vwap_slope", "distance_session_vwap_atr", "session_vwap_slope", "distance_prior_high_atr", "distance_prior_low_atr", "sweep_prior_high",
    "sweep_prior_low", "iso_weekday", "time_sin", "time_cos", "month", "minute_of_session", "session_progress", "h1_body", "h1_direction", "h1_return_1")


def add_availability(df: DataFrame, minutes: int = 15) -> DataFrame:
    return df.withColumns({"observation_time_utc": minutes_after("timestamp_utc", minutes), "observation_time_cot": minutes_after("timestamp_cot", minutes)})


def add_geometry(df: DataFrame) -> DataFrame:
    size, body = F.col("high") - F.col("low"), F.col("close") - F.col("open")
    return df.withColumns({
        "body": body, "body_abs": F.abs(body), "bar_range": size, "upper_wick": F.col("high") - F.greatest("open", "close"), "lower_wick": F.least("open", "close") - F.col("low"),
        "body_to_range": F.when(F.abs(size) > EPSILON, body / size).otherwise(0.0), "close_location": F.when(F.abs(size) > EPSILON, (F.col("close") - F.col("low")) / size).otherwise(0.5),
        "candle_direction": direction()})


def _returns(df: DataFrame, w: WindowSpec) -> DataFrame:
    back = lambda k: F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1.0
    df = df.withColumns({"return_15m": back(1), "return_30m": back(2), "return_60m": back(4), "_step": F.signum(F.col("close") - F.lag("close").over(w))})
    return df.withColumns({
        "realized_vol_60m": rolling(F.stddev_samp, F.col("return_15m"), 4, w), "realized_vol_4h": rolling(F.stddev_samp, F.col("return_15m"), 16, w),
        "direction_balance_60m": rolling(F.sum, F.col("_step"), 4, w).cast("byte")}).drop("_step")


def add_returns(df: DataFrame) -> DataFrame:
    return in_blocks(df, _returns, RETURN_ROWS)


def _atr(df: DataFrame, w: WindowSpec, period: int) -> DataFrame:
    if period < 2:
        raise ValueError("period is below 2")
    before = F.lag("close").over(w)
    df = df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    df = df.withColumn("atr", rolling(F.avg, F.col("true_range"), period, w))
    return df.withColumns({"range_atr": ratio(F.col("bar_range"), F.col("atr"), EPSILON), "body_atr": ratio(F.col("body"), F.col("atr"), EPSILON)})


def add_atr(df: DataFrame, period: int = 14) -> DataFrame:
    return in_blocks(df, lambda d, w: _atr(d, w, period), period + 1)


def _volume(df: DataFrame, w: WindowSpec, short: int = 4, reference: int = 32) -> DataFrame:
    if short < 1 or reference < 2:
        raise ValueError("windows are too short")
    v = F.col("volume")
    df = df.withColumns({"volume_sum_short": rolling(F.sum, v, short, w), "volume_mean_prior": rolling(F.avg, v, reference, w, prior=True), "volume_std_prior": rolling(F.stddev_samp, v, reference, w, prior=True)})
    return df.withColumns({
        "volume_ratio": ratio(v, F.col("volume_mean_prior")), "volume_zscore": ratio(v - F.col("volume_mean_prior"), F.col("volume_std_prior"), EPSILON),
        "real_to_tick_volume": ratio(F.col("real_volume"), v, 0.0, 0.0)})


def add_volume(df: DataFrame, short: int = 4, reference: int = 32) -> DataFrame:
    return in_blocks(df, lambda d, w: _volume(d, w, short, reference), max(short, reference))


def add_daily_vwap(df: DataFrame) -> DataFrame:
    """VWAP since local midnight; its slope is null on the first bar of each date."""
    df = df.withColumns({"calendar_date": F.to_date("timestamp_cot"), "typical_price": typical_price()})
    w = series(by=("symbol", "calendar_date"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("daily_vwap", ratio(F.sum(F.col("typical_price") * F.col("volume")).over(upto), F.sum("volume").over(upto)))
    away = F.col("close") - F.col("daily_vwap")
    return df.withColumns({"distance_daily_vwap": away, "distance_daily_vwap_atr": ratio(away, F.col("atr"), EPSILON), "daily_vwap_slope": F.col("daily_vwap") - F.lag("daily_vwap").over(w)})


def _prior_extremes(df: DataFrame, w: WindowSpec, lookback: int = 16) -> DataFrame:
    if lookback < 2:
        raise ValueError("lookback is below 2")
    df = df.withColumns({"prior_high": rolling(F.max, F.col("high"), lookback, w, prior=True), "prior_low": rolling(F.min, F.col("low"), lookback, w, prior=True)})
    high, low, close = F.col("prior_high"), F.col("prior_low"), F.col("close")
    return df.withColumns({
        "distance_prior_high_atr": ratio(high - close, F.col("atr"), EPSILON), "distance_prior_low_atr": ratio(close - low, F.col("atr"), EPSILON),
        "sweep_prior_high": ((F.col("high") > high) & (close < high)).cast("byte"), "sweep_prior_low": ((F.col("low") < low) & (close > low)).cast("byte")})


def add_prior_extremes(df: DataFrame, lookback: int = 16) -> DataFrame:
    return in_blocks(df, lambda d, w: _prior_extremes(d, w, lookback), lookback)


def context_features(h1: DataFrame, minutes: int = 60) -> DataFrame:
    """Context bars by the time they are complete."""
    change = lambda d, w: d.withColumn("h1_return_1", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1.0)
    return in_blocks(h1, change, 1).select("symbol", minutes_after("timestamp_utc", minutes).alias("h1_available_at_utc"), (F.col("close") - F.col("open")).alias("h1_body"), direction().alias("h1_direction"), "h1_return_1")


def join_context(df: DataFrame, context: DataFrame) -> DataFrame:
    """The last context bar that is complete when the observation bar closes."""
    return asof_join(df, "observation_time_utc", Source(context, "h1_available_at_utc", ["h1_available_at_utc", "h1_body", "h1_direction", "h1_return_1"]))


def add_session_vwap(df: DataFrame) -> DataFrame:
    """VWAP since the session's first bar; the slope is 0 there."""
    w = series("observation_time_utc", ("symbol", "session_code", "session_date"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("session_vwap", ratio(F.sum(F.col("typical_price") * F.col("volume")).over(upto), F.sum("volume").over(upto)))
    away = F.col("close") - F.col("session_vwap")
    slope = F.coalesce(F.col("session_vwap") - F.lag("session_vwap").over(w), F.lit(0.0))
    return df.withColumns({"distance_session_vwap": away, "distance_session_vwap_atr": ratio(away, F.col("atr"), EPSILON), "session_vwap_slope": slope})


def feature_frame(m15: DataFrame, h1: DataFrame, session: SessionWindow, config: ExperimentConfig = ExperimentConfig(), drop_incomplete: bool = True, check: bool = True) -> DataFrame:
    """All features of the bars of a session; rows with a null among MODEL_FEATURES go unless drop_incomplete is off.

    With check, both frames of bars are stored and tested on the way (`quality.checked_bars`), so each is evaluated once.
    """
    if check:
        m15, h1 = checked_bars(m15, "the observation bars"), checked_bars(h1, "the context bars")
    df = add_geometry(add_availability(m15, config.observation_minutes))
    history = lambda d, w: _prior_extremes(_volume(_atr(_returns(d, w), w, config.atr_period), w), w)
    df = add_daily_vwap(in_blocks(df, history, max(HISTORY_ROWS, config.atr_period + 1)))
    df = join_context(add_time_features(df), context_features(h1, config.context_minutes))
    df = add_session_vwap(filter_observations(df, session))
    if drop_incomplete:
        for c in MODEL_FEATURES:
            df = df.where(F.col(c).isNotNull())
    return df
