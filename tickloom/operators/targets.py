"""Future excursions, threshold targets and the triple barrier, from the bars between an observation and its horizon.

Time is cut into blocks of one horizon, so a path is the end of one block and the beginning of the next. Observations are
set among the bars as two marks, where the path begins and where it ends; running extremes from a mark to the end of its
block, and from the beginning of a block to a mark, put together, are those of the path. No path is ever listed. Only the
observations whose extremes touch a barrier meet their bars, in an equi-join on blocks, to find when.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.contracts import ExperimentConfig
from tickloom.functions.calendar import SessionWindow, minutes_after
from tickloom.functions.keys import match
from tickloom.functions.stored import stored
from tickloom.operators.quality import require_columns, require_none

REASONS = ("horizon_outside_session", "invalid_atr", "incomplete_horizon", "m1_gap", "ambiguous_barrier")
KEY = ["symbol", "session_code", "observation_time_utc"]


def _bucket(ts: Column, minutes: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * minutes)).cast("long")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def path_extremes(observations: DataFrame, bars: DataFrame, config: ExperimentConfig) -> DataFrame:
    """For each KEY the bars in [observation, horizon end): _n, _even (no time twice, all a whole number of steps away), _top
    (highest high and its first time), _bottom (lowest low and its first time) and _adverse (lowest low up to the top)."""
    h, step = config.horizon_minutes, config.path_minutes * 60_000_000
    keys = observations.select(*KEY).distinct()
    start, end = F.col("observation_time_utc"), minutes_after("observation_time_utc", h)
    own = F.struct("session_code", "observation_time_utc")
    mark = lambda at, side: keys.select("symbol", _bucket(at, h).alias("_block"), at.alias("_ts"), F.lit(0).alias("_bar"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low"), own.alias("_own"), F.lit(side).alias("_side"))
    marks = mark(start, "start").unionByName(mark(end, "end"))
    at = F.col("timestamp_utc")
    rows = bars.select("symbol", _bucket(at, h).alias("_block"), at.alias("_ts"), F.lit(1).alias("_bar"), "high", "low", F.lit(None).cast(marks.schema["_own"].dataType).alias("_own"), F.lit(None).cast("string").alias("_side"))
    order = Window.partitionBy("symbol", "_block").orderBy("_ts", "_bar")  # a mark stands before a bar of its time
    later, sooner = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    bar, us = F.col("_bar") == 1, _micros(F.col("_ts"))
    of = lambda c: F.when(bar, c)
    again = bar & (F.lag("_bar").over(order) == 1) & (F.lag("_ts").over(order) == F.col("_ts"))
    rows = rows.unionByName(marks).withColumns({"_us": us, "_again": of(F.coalesce(again, F.lit(False)).cast("int")), "_phase": of(F.pmod(us, F.lit(step))), "_least": F.min("low").over(sooner)})
    top = of(F.struct(F.col("high").alias("v"), (-F.col("_us")).alias("minus"), F.col("_least").alias("adverse")))
    bottom = of(F.struct(F.col("low").alias("v"), F.col("_us").alias("us")))

    def figures(over) -> dict[str, Column]:
        return {"_n": F.count(of(F.lit(1))).over(over), "_repeats": F.max("_again").over(over), "_from": F.min("_phase").over(over), "_to": F.max("_phase").over(over),
                "_top": F.max(top).over(over), "_bottom": F.min(bottom).over(over)}

    after, before = figures(later), figures(sooner)
    rows = rows.withColumns({f"{k}_after": c for k, c in after.items()} | {f"{k}_before": c for k, c in before.items()})
    same_top = Window.partitionBy("symbol", "_block", "_top_after.minus").orderBy("_ts", "_bar").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_adverse_after", F.min("low").over(same_top)).where(~bar)  # rows with one top ahead end with it
    starts, ends = F.col("_side") == "start", F.col("_side") == "end"
    taken = [F.max(F.when(starts, F.col(f"{k}_after"))).alias(f"{k}_after") for k in after] + [F.max(F.when(ends, F.col(f"{k}_before"))).alias(f"{k}_before") for k in before]
    out = rows.groupBy("symbol", "_own").agg(*taken, F.max(F.when(starts, F.col("_adverse_after"))).alias("_adverse_after")).select("*", "_own.*")
    a, b = F.col("_top_after"), F.col("_top_before")
    first = F.coalesce(a["v"] >= b["v"], a.isNotNull())  # the earlier of equal tops
    phase = F.pmod(_micros(F.col("observation_time_utc")), F.lit(step))
    even = (F.coalesce(F.greatest("_repeats_after", "_repeats_before"), F.lit(0)) == 0) & (F.least("_from_after", "_from_before") == phase) & (F.greatest("_to_after", "_to_before") == phase)
    when = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
    c, d = F.col("_bottom_after"), F.col("_bottom_before")
    low_first = F.coalesce(c["v"] <= d["v"], c.isNotNull())
    return out.select(
        *KEY, (F.col("_n_after") + F.col("_n_before")).alias("_n"), F.coalesce(even, F.lit(False)).alias("_even"),
        F.struct(F.when(first, a["v"]).otherwise(b["v"]).alias("v"), when(-F.when(first, a["minus"]).otherwise(b["minus"])).alias("at")).alias("_top"),
        F.struct(F.when(low_first, c["v"]).otherwise(d["v"]).alias("v"), when(F.when(low_first, c["us"]).otherwise(d["us"])).alias("at")).alias("_bottom"),
        F.when(first, F.col("_adverse_after")).otherwise(F.least(c["v"], b["adverse"])).alias("_adverse"))


def barrier_times(observations: DataFrame, bars: DataFrame, config: ExperimentConfig) -> DataFrame:
    """KEY, _up and _down: when a bar in [observation, horizon end) first reaches `_upper` or `_lower`."""
    h = config.horizon_minutes
    obs = observations.select(*KEY, "target_horizon_end_utc", "_upper", "_lower").dropDuplicates(KEY)
    first = _bucket(F.col("observation_time_utc"), h)
    obs = obs.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, _bucket(F.col("target_horizon_end_utc") - F.expr("INTERVAL 1 MICROSECOND"), h)))))
    own = bars.select(F.col("symbol").alias("_symbol"), F.col("timestamp_utc").alias("_ts"), "high", "low", _bucket(F.col("timestamp_utc"), h).alias("_b"))
    inside = (F.col("_ts") >= F.col("observation_time_utc")) & (F.col("_ts") < F.col("target_horizon_end_utc"))
    hits = (F.col("high") >= F.col("_upper")) | (F.col("low") <= F.col("_lower"))
    joined = obs.join(own, (F.col("symbol") == F.col("_symbol")) & (F.col("_bucket") == F.col("_b")) & inside & hits)
    return joined.groupBy(*KEY).agg(F.min(F.when(F.col("high") >= F.col("_upper"), F.col("_ts"))).alias("_up"), F.min(F.when(F.col("low") <= F.col("_lower"), F.col("_ts"))).alias("_down"))


def observation_violations(observations: DataFrame, session: SessionWindow) -> DataFrame:
    """Counts of observations without a key, of another session than the one asked for, or with a repeated key."""
    no_key = F.col("symbol").isNull() | F.col("session_code").isNull() | F.col("observation_time_utc").isNull()
    repeated = observations.groupBy(*KEY).agg(F.count("*").alias("_n"))
    tests = {"no_key": no_key, "other_session": F.col("session_code") != session.code}
    each = repeated.withColumns({k: F.when(F.coalesce(c, F.lit(False)), F.col("_n")).otherwise(F.lit(0)) for k, c in tests.items()})
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in tests]
    return each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), *sums, F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeated"))


def check_observations(observations: DataFrame, session: SessionWindow) -> None:
    require_columns(observations, [*KEY, "session_date", "close", "atr"], "the observations")
    require_none(observation_violations(observations, session), "the observations")


def peak_targets(observations: DataFrame, bars: DataFrame, session: SessionWindow, config: ExperimentConfig = ExperimentConfig(), drop_invalid: bool = True, check: bool = True) -> DataFrame:
    """Adds the targets to observations of one session (features, with atr and close). Reasons are given in this order:
    horizon outside the session, unusable ATR, incomplete path, gap in the path, ambiguous barrier. With check, a ValueError
    tells of observations that are missing, repeated or of another session."""
    if config.ambiguous_policy == "resolve_with_ticks":
        raise NotImplementedError("ambiguous barriers are not resolved with ticks")
    observations = stored(observations)
    if check:
        check_observations(observations, session)
    step, n = config.path_minutes, config.horizon_minutes // config.path_minutes
    start, end = session.bounds_utc(F.col("session_date"))
    df = observations.withColumns({"target_horizon_end_utc": minutes_after("observation_time_utc", config.horizon_minutes), "session_start_utc": start, "session_end_utc": end, "reference_price": F.col("close")})
    df = match(df, stored(path_extremes(observations, bars, config)), KEY, "left")
    ref, atr = F.col("reference_price"), F.col("atr")
    inside = (F.col("observation_time_utc") >= start) & (F.col("target_horizon_end_utc") <= end)
    sound = F.coalesce((atr > 0) & ~F.isnan(atr) & (atr < float("inf")), F.lit(False))
    reason = F.when(~inside, REASONS[0]).when(~sound, REASONS[1]).when(F.coalesce("_n", F.lit(0)) != n, REASONS[2]).when(~F.col("_even"), REASONS[3])
    df = df.withColumn("_reason", reason)
    ok = F.col("_reason").isNull()
    when = lambda c: F.when(ok, c)
    since = lambda ts: ((_micros(ts) - _micros(F.col("observation_time_utc"))) / 60_000_000 + step).cast("int")
    df = df.withColumns({"future_high": when(F.col("_top.v")), "future_low": when(F.col("_bottom.v"))})
    df = df.withColumns({  # greatest skips nulls, so excluded rows need their nulls back
        "mfe_points": when(F.greatest(F.col("future_high") - ref, F.lit(0.0))), "mae_points": when(F.greatest(ref - F.col("future_low"), F.lit(0.0))), "adverse_before_peak_points": when(F.greatest(ref - F.col("_adverse"), F.lit(0.0)))})
    per_atr = {c.replace("_points", "_atr"): when(F.try_divide(F.col(c), atr)) for c in ("mfe_points", "mae_points", "adverse_before_peak_points")}
    df = df.withColumns(per_atr | {
        "time_to_peak_minutes": when(since(F.col("_top.at"))), "time_to_trough_minutes": when(since(F.col("_bottom.at"))),
        "peak_timestamp_utc": when(F.col("_top.at")), "trough_timestamp_utc": when(F.col("_bottom.at"))})
    df = df.withColumns({c: when((F.col("mfe_atr") >= t).cast("int")) for c, t in zip(config.thresholds.columns, config.thresholds.heights)})
    df = df.withColumns({"_upper": when(ref + config.thresholds.barrier * atr), "_lower": when(ref - config.adverse_barrier_atr * atr)})
    touched = df.where((F.col("future_high") >= F.col("_upper")) | (F.col("future_low") <= F.col("_lower")))
    return _barrier(match(df, barrier_times(touched, bars, config), KEY, "left"), config, ok, since, drop_invalid)


def _barrier(df: DataFrame, config: ExperimentConfig, ok: Column, since: Callable[[Column], Column], drop_invalid: bool) -> DataFrame:
    up, down = F.col("_up"), F.col("_down")
    tie = F.coalesce(up == down, F.lit(False))
    label = (F.when(up.isNull() & down.isNull(), 0).when(down.isNull() | (up < down), 1).when(up.isNull() | (down < up), -1)
             .otherwise(F.lit(None if config.ambiguous_policy == "exclude" else -1).cast("int")))
    reason = F.when(tie & F.lit(config.ambiguous_policy == "exclude"), REASONS[4]).otherwise(F.col("_reason"))
    out = df.withColumns({
        "triple_barrier_label": F.when(ok, label), "triple_barrier_threshold_atr": F.when(ok, F.lit(config.thresholds.barrier)), "adverse_barrier_threshold_atr": F.when(ok, F.lit(config.adverse_barrier_atr)),
        "first_barrier_touch_minutes": since(F.least(up, down)), "target_ambiguous": tie, "target_exclusion_reason": reason,
        "target_horizon_inside_session": ~F.coalesce(F.col("_reason") == REASONS[0], F.lit(False)), "target_valid": reason.isNull()})
    out = out.drop("_n", "_even", "_top", "_bottom", "_adverse", "_reason", "_upper", "_lower", "_up", "_down")
    return out.where("target_valid") if drop_invalid else out


def exclusion_report(targets: DataFrame) -> DataFrame:
    """Rows by reason (`valid` for those without) and how many were ambiguous; targets built with drop_invalid off."""
    return targets.groupBy(F.coalesce("target_exclusion_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("rows"), F.count_if("target_ambiguous").alias("ambiguous"))
