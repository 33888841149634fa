"""Data-quality gates: each is one aggregation that counts violations, and a check that raises ValueError."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from tickloom.functions.stored import stored

VALUES = ("open", "high", "low", "close", "volume", "spread", "real_volume")


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks {missing}")


def _counts(tests: Mapping[str, Column]) -> list[Column]:
    return [F.count("*").alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in tests.items()]]


def counters(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row: rows and how many rows meet each test."""
    return df.agg(*_counts(tests))


def observed(df: DataFrame, tests: Mapping[str, Column], what: str, allow_empty: bool = False) -> DataFrame:
    """df as a stored table; the tests are counted on its way there, and what they find is a ValueError."""
    seen = Observation()
    kept = stored(df.observe(seen, *_counts(tests)))
    _refuse(dict(seen.get), what, allow_empty)
    return kept


def require_none(counted: DataFrame, what: str, allow_empty: bool = False) -> None:
    _refuse(counted.first().asDict(), what, allow_empty)


def _refuse(row: dict[str, int], what: str, allow_empty: bool) -> None:
    rows = row.pop("rows")
    found = {k: v for k, v in row.items() if v}
    if found or (rows == 0 and not allow_empty):
        raise ValueError(f"{what}: {found or 'no rows'}")


def bar_violations(bars: DataFrame) -> DataFrame:
    names = ["timestamp_utc", *VALUES]
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    repeated = bars.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "timestamp_utc")))
    any_null = F.lit(False)
    for n in names:
        any_null = any_null | F.col(n).isNull()
    return counters(repeated, {
        "nulls": any_null, "non_positive": F.least(o, h, lo, c) <= 0, "high_below": h < F.greatest(o, c), "low_above": lo > F.least(o, c), "high_below_low": h < lo,
        "negative_volume": F.least(F.col("volume"), F.col("spread"), F.col("real_volume")) < 0, "repeated_times": F.col("_n") > 1})


def validate_bars(bars: DataFrame) -> None:
    require_columns(bars, ["symbol", "timestamp_utc", *VALUES], "the bar frame")
    require_none(bar_violations(bars), "OHLC bars")


def checked_bars(bars: DataFrame, what: str) -> DataFrame:
    """Bars as a stored table; no rows, a missing column, a row without symbol or time, or a time given twice is a ValueError."""
    require_columns(bars, ["symbol", "timestamp_utc", *VALUES], what)
    rows = bars.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "timestamp_utc")))
    return observed(rows, {"no_key": F.col("symbol").isNull() | F.col("timestamp_utc").isNull(), "repeated_times": F.col("_n") > 1}, what).drop("_n")


def reconcile(bars: DataFrame) -> tuple[DataFrame, int]:
    """(one row for each symbol and time, how many rows went); rows that share a time and differ are a ValueError."""
    times = bars.groupBy("symbol", "timestamp_utc").agg(F.countDistinct(F.struct(*VALUES)).alias("versions"), F.count("*").alias("n"))
    found = times.where("n > 1").agg(F.count_if(F.col("versions") > 1).alias("clashes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"), F.min(F.when(F.col("versions") > 1, F.col("timestamp_utc"))).alias("earliest")).first()
    if found.clashes:
        raise ValueError(f"{found.clashes} conflicting duplicates, the first at {found.earliest}")
    return bars.dropDuplicates(["symbol", "timestamp_utc"]), found.removed


def reconcile_duplicates(bars: DataFrame) -> DataFrame:
    return reconcile(bars)[0]


def probability_violations(df: DataFrame, probability: str, actual: str = "actual_target") -> DataFrame:
    p = F.col(probability)
    ids = df.withColumn("_n", F.count("*").over(Window.partitionBy("observation_id")))
    return counters(ids, {"null_probability": p.isNull(), "not_finite": F.isnan(p) | (F.abs(p) == float("inf")), "outside": (p < 0) | (p > 1),
                          "repeated_ids": F.col("_n") > 1, "bad_actual": F.col(actual).isNull() | ~F.col(actual).isin(0, 1)})


def validate_probabilities(df: DataFrame, probability: str, actual: str = "actual_target") -> None:
    require_columns(df, ["observation_id", probability, actual], "the prediction frame")
    require_none(probability_violations(df, probability, actual), f"probabilities {probability}")


def validate_binary(df: DataFrame, target: str, both: bool = False) -> None:
    found = {r[0] for r in df.select(target).distinct().limit(4).collect()}
    if not found or not found <= {0, 1} or (both and found != {0, 1}):
        raise ValueError(f"{target} holds {sorted(map(str, found))}")
