"""Exact quantiles of groups by distributed selection.

A double has a bucket that rises with it: 2^OCTAVE of them between a power of two and the next, each cut into 2^INSIDE
parts. Counts by bucket tell which bucket holds each wanted rank, counts by part inside these buckets tell the part, and
only the distinct values of those parts are put in order. Whatever the number of rows, a task orders one part, and the
counts of a group have a bounded size. Ties are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.keys import match

OCTAVE, INSIDE = 10, 14  # bits
_ZERO_TO = 1100  # added to exponents, so that the smallest numbers have positive buckets


def _place(v: Column) -> tuple[Column, Column]:
    """(bucket, part) of a double that is not null. Every step but the logarithm is exact, and an exponent that is one off gives the same bucket."""
    size = F.abs(v)
    odd = F.isnan(v) | (size == float("inf")) | (size == 0.0)
    exponent = F.floor(F.log2(F.when(odd, 1.0).otherwise(size)))
    steps = (F.when(odd, 1.0).otherwise(size) / F.pow(F.lit(2.0), exponent) - 1.0) * 2.0**OCTAVE
    bucket = (exponent + _ZERO_TO) * 2**OCTAVE + F.floor(steps)
    top = F.lit(4 * _ZERO_TO * 2**OCTAVE)
    sign = F.when(v < 0, -1).otherwise(1)
    part = F.floor((steps - F.floor(steps)) * 2.0**INSIDE)
    return (F.when(F.isnan(v), top + 1).when(size == float("inf"), sign * top).when(size == 0.0, F.lit(0)).otherwise(sign * bucket).cast("long"),
            F.when(odd, F.lit(0)).otherwise(sign * part).cast("int"))


def _select(counts: DataFrame, wanted: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
    """wanted (keys, rank) with the `on` of counts (keys, on, n) that holds the rank, and the rank inside it."""
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(on).rowsBetween(Window.unboundedPreceding, -1))
    ranged = counts.withColumn("_from", F.coalesce(before, F.lit(0))).withColumn("_upto", F.col("_from") + F.col("n"))
    ranged = ranged.drop("n")
    held = match(wanted, ranged, keys).where("rank >= _from AND rank < _upto")
    return held.withColumn("rank", F.col("rank") - F.col("_from")).drop("_from", "_upto")


def exact_quantiles(df: DataFrame, by: Sequence[str], measures: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(by, q_<measure> for each measure): arrays of the quantiles at `probabilities`, by linear interpolation between ranks.

    Nulls do not count, a measure without values has a null array, NaN is the largest value, null groups are groups of
    their own. df is read three times: give a stored or cheap one. Without `by` there is one row.
    """
    keys = [*by, "_measure"]
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("v")) for m in measures])).alias("_m"))
    long = long.select(*by, F.col("_m.name").alias("_measure"), F.col("_m.v").alias("_v")).where("_v IS NOT NULL")
    bucket, part = _place(F.col("_v"))
    long = long.select(*keys, "_v", bucket.alias("_bucket"), part.alias("_part"))
    coarse = long.groupBy(*keys, "_bucket").agg(F.count("*").alias("n"))
    place = [F.struct(F.lit(i).alias("i"), ((F.col("rows") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(probabilities)]
    goals = coarse.groupBy(*keys).agg(F.sum("n").alias("rows")).select(*keys, F.explode(F.array(*place)).alias("_q"))
    goals = goals.select(*keys, "_q.*").withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("rank", F.col("_r"))
    goals = _select(coarse, goals, keys, "_bucket")

    def inside(also: Sequence[str], value: str) -> DataFrame:
        """Counts of `value` in the wanted places alone."""
        own = [*keys, *also]
        return match(long, goals.select(*own).distinct(), own, "left_semi").groupBy(*own, value).agg(F.count("*").alias("n"))

    goals = _select(inside(["_bucket"], "_part"), goals, [*keys, "_bucket"], "_part")
    goals = _select(inside(["_bucket", "_part"], "_v"), goals, [*keys, "_bucket", "_part"], "_v")
    share = F.col("at") - F.floor("at")
    low, high = F.max(F.when(F.col("_r") == F.floor("at"), F.col("_v"))), F.max(F.when(F.col("_r") == F.ceil("at"), F.col("_v")))
    value = F.when(low == high, low).otherwise((1 - F.first(share)) * low + F.first(share) * high)
    found = goals.groupBy(*keys, "i").agg(value.alias("_value"))
    arrays = [F.collect_list(F.when(F.col("_measure") == m, F.struct("i", "_value"))).alias(f"q_{m}") for m in measures]
    out = found.groupBy(*by).agg(*arrays)
    return out.select(*by, *[F.when(F.size(f"q_{m}") > 0, F.transform(F.array_sort(f"q_{m}"), lambda x: x["_value"])).alias(f"q_{m}") for m in measures])
