"""Historical frequencies as baselines, and constant predictions from training rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.calendar import WEEKDAYS
from tickloom.functions.keys import match
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.stored import stored

TARGETS = ("target_peak_050_atr", "target_peak_075_atr", "target_peak_100_atr")
ALL_MEDIANS = ("mfe_atr", "mae_atr", "time_to_peak_minutes")
MAX_BROADCAST_GROUPS = 200_000


def _narrow(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, evaluated once for all figures on them."""
    return stored(df.select(*dict.fromkeys(columns)))


def _figures(narrow: DataFrame, by: Sequence[str], targets: Sequence[str], counts: bool, medians: Sequence[str], least: int = 1) -> DataFrame:
    """Rows, rates and exact medians of each group of at least `least` rows."""
    out = [F.count("*").alias("observations")]
    out += [F.sum(t).alias(f"positive_{t}") for t in targets] if counts else []
    rates = narrow.groupBy(*by).agg(*out, *[F.avg(t).alias(f"rate_{t}") for t in targets]).where(F.col("observations") >= (least if by else 0))
    middle = exact_quantiles(narrow, by, medians, (0.5,)).select(*by, *[F.col(f"q_{m}")[0].alias(f"median_{m}") for m in medians])
    return match(rates, middle, by, "left")


def global_rates(df: DataFrame, targets: Sequence[str] = TARGETS, medians: Sequence[str] = ALL_MEDIANS) -> DataFrame:
    return _figures(_narrow(df, *targets, *medians), (), targets, True, medians)


def by_session(df: DataFrame, targets: Sequence[str] = TARGETS, medians: Sequence[str] = ALL_MEDIANS) -> DataFrame:
    return _figures(_narrow(df, "session_code", *targets, *medians), ("session_code",), targets, True, medians)


def by_session_minute(df: DataFrame, targets: Sequence[str] = TARGETS, least: int = 1, medians: Sequence[str] = ("mfe_atr", "mae_atr")) -> DataFrame:
    if least < 1:
        raise ValueError("least is below 1")
    by = ("session_code", "minute_of_session")
    return _figures(_narrow(df, *by, *targets, *medians), by, targets, False, medians, least)


def by_weekday(df: DataFrame, targets: Sequence[str] = TARGETS, medians: Sequence[str] = ("mfe_atr", "mae_atr")) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])
    by = ("session_code", "iso_weekday")
    out = _figures(_narrow(df.withColumn("iso_weekday", F.col("iso_weekday").cast("int")), *by, *targets, *medians), by, targets, False, medians)
    return out.withColumn("weekday", F.coalesce(names[F.col("iso_weekday")], F.lit("Unknown")))


def _terciles(narrow: DataFrame) -> DataFrame:
    numbers = narrow.select(F.when(~F.isnan("atr"), F.col("atr")).alias("atr"))
    cuts = exact_quantiles(numbers, (), ("atr",), (1 / 3, 2 / 3)).agg(F.first("q_atr").alias("q"))  # a row even where there is none
    return cuts.select(F.col("q")[0].alias("q33"), F.col("q")[1].alias("q67"))


def atr_terciles(df: DataFrame) -> DataFrame:
    """One row (q33, q67): exact quantiles with linear interpolation, both null without values; null and NaN do not count."""
    return _terciles(_narrow(df, "atr"))


def add_regime(df: DataFrame, q33: float | None, q67: float | None) -> DataFrame:
    """volatility_regime, null where the ATR is null or not a number; q33 and q67."""
    out = df.withColumns({"q33": F.lit(q33).cast("double"), "q67": F.lit(q67).cast("double")})
    known = F.col("atr").isNotNull() & ~F.isnan("atr")
    return out.withColumn("volatility_regime", F.when(known & (F.col("atr") <= F.col("q33")), "low").when(known & (F.col("atr") <= F.col("q67")), "medium").when(known, "high"))


def by_regime(df: DataFrame, reference: DataFrame | None = None, targets: Sequence[str] = TARGETS, medians: Sequence[str] = ("mfe_atr", "mae_atr")) -> DataFrame:
    """By session and ATR tercile of the reference (df itself by default); df is evaluated once."""
    narrow, by = _narrow(df, "session_code", "atr", *targets, *medians), ("session_code", "volatility_regime")
    cuts = (_terciles(narrow) if reference is None else atr_terciles(reference)).first()  # one row
    out = _figures(add_regime(narrow, *cuts), by, targets, False, medians)
    return out.withColumns({"q33": F.lit(cuts.q33).cast("double"), "q67": F.lit(cuts.q67).cast("double")})


def report(df: DataFrame, targets: Sequence[str] = TARGETS) -> dict[str, DataFrame]:
    return {"global": global_rates(df, targets), "session": by_session(df, targets), "session_minute": by_session_minute(df, targets), "weekday": by_weekday(df, targets), "regime": by_regime(df, targets=targets)}


def constant_predictions(train: DataFrame, inference: DataFrame, target: str = "target_peak_075_atr", groups: Sequence[str] = (), least: int = 1, fall_back: bool = True) -> DataFrame:
    """The training rate, or that of the row's group if the group has `least` rows; inference targets are never read."""
    if target not in train.columns or set(groups) - (set(train.columns) & set(inference.columns)):
        raise ValueError("the target or a group column is missing")
    overall = train.agg(F.avg(target).cast("double").alias("_global"))  # one row
    if not groups:
        return (inference.select("observation_id").crossJoin(F.broadcast(overall))
                .select("observation_id", F.col("_global").alias("baseline_probability"), F.lit("global").alias("baseline_source"), F.lit(target).alias("baseline_target")))
    rates = train.groupBy(*groups).agg(F.count("*").alias("baseline_group_observations"), F.avg(target).alias("baseline_group_probability")).where(F.col("baseline_group_observations") >= least)
    small = rates.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    out = inference.select("observation_id", *groups).join(F.broadcast(rates) if small else rates, list(groups), "left")
    own = F.col("baseline_group_probability")
    if fall_back:
        out = out.crossJoin(F.broadcast(overall)).withColumns({"baseline_probability": F.coalesce(own, "_global"), "baseline_source": F.when(own.isNull(), "global_fallback").otherwise("group")}).drop("_global")
    else:
        out = out.withColumns({"baseline_probability": own, "baseline_source": F.lit("group")})
    return out.withColumn("baseline_target", F.lit(target))
