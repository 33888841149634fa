"""Row windows with minimum samples, running totals and as-of joins that do not need one task per series.

A long series is cut by a bucket column (a local date, say) that rises with its order column: windows run inside
(key, bucket) and a summary row per bucket carries what earlier buckets add.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tickloom.functions.keys import match

BLOCK_ROWS = 16384  # of a series, for windows of bounded length


def series(order: str = "timestamp_utc", by: Sequence[str] = ("symbol",)) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def rolling(agg: Callable[[Column], Column], value: Column, rows: int, over: WindowSpec, least: int | None = None, prior: bool = False) -> Column:
    """agg over the last `rows` rows (before the current one if prior), null below `least` non-null values."""
    frame = over.rowsBetween(-rows, -1) if prior else over.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) >= (rows if least is None else least), agg(value).over(frame))


def ratio(top: Column, bottom: Column, least: float = 0.0, otherwise: Column | float | None = None) -> Column:
    """top / bottom where bottom > least."""
    return F.when(bottom > least, top / bottom).otherwise(F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def in_blocks(df: DataFrame, step: Callable[[DataFrame, WindowSpec], DataFrame], lookback: int, order: str = "timestamp_utc", by: Sequence[str] = ("symbol",), block_rows: int | None = None) -> DataFrame:
    """step(df, window) for windows along `order` that reach back at most `lookback` rows, in all its steps together.

    Rows are numbered over the whole of each key (a count for each UTC date, then inside the date) and cut into blocks of
    `block_rows`; the last `lookback` rows of a block go into the next one too and are dropped there afterwards. Frames
    hold the same rows as over the whole series, nulls of `order` come first, and a task holds one block.
    """
    size = block_rows or BLOCK_ROWS
    if not 1 <= lookback <= size:
        raise ValueError("the lookback must be between 1 and the rows of a block")
    dated = df.withColumn("_row_date", F.coalesce(F.to_date(order), F.lit("0001-01-01").cast("date")))
    keys = [*by, "_row_date"]
    earlier = Window.partitionBy(*by).orderBy("_row_date").rowsBetween(Window.unboundedPreceding, -1)
    before = dated.groupBy(*keys).agg(F.count("*").alias("_rows")).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    numbered = dated.withColumn("_row_in_date", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).join(before, same)
    numbered = numbered.withColumn("_row", F.col("_rows_before") + F.col("_row_in_date") - 1).drop("_row_date", "_row_in_date", "_rows_before", *[f"_key{i}" for i in range(len(keys))])
    own = F.floor(F.col("_row") / size)
    blocks = F.when(F.col("_row") % size >= size - lookback, F.array(own, own + 1)).otherwise(F.array(own))
    out = step(numbered.withColumn("_block", F.explode(blocks)), Window.partitionBy(*by, "_block").orderBy("_row"))
    return out.where(F.col("_block") == own).drop("_row", "_block")


def _carried(rows: DataFrame, by: Sequence[str], bucket: str, summary: Mapping[str, Column], carry: Mapping[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """rows with the columns of `carry`: window expressions over the summaries of the earlier buckets of a key, in their order."""
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, bucket).agg(*[c.alias(k) for k, c in summary.items()])
    return match(rows, sums.select(*by, bucket, *[f(earlier).alias(k) for k, f in carry.items()]), [*by, bucket])


def running_totals(df: DataFrame, totals: Mapping[str, Column], order: Sequence[str], bucket: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adds running sums along `order` over the whole of each key."""
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda k: lambda earlier: F.coalesce(F.sum(f"_sum_{k}").over(earlier), F.lit(0))
    out = _carried(df, by, bucket, {f"_sum_{k}": F.sum(c) for k, c in totals.items()}, {f"_before_{k}": before(k) for k in totals})
    return out.withColumns({k: F.col(f"_before_{k}") + F.sum(c).over(inside) for k, c in totals.items()}).drop(*[f"_before_{k}" for k in totals])


def change_totals(df: DataFrame, value: str, amount: Callable[[Column], Column], uses: Sequence[str], into: str, order: Sequence[str], bucket: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adds `_before` (the value of the row before) and `into`, the running sum of amount(_before), over the whole of each key.

    One summary of each bucket carries both: its last value, the sum over its rows but the first, and the columns of the
    first row that amount needs besides the value before (`uses`). Rows and summaries read one exchange.
    """
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    at, before = F.struct(*order), F.lag(value).over(inside)
    rows = df.withColumns({"_first": F.row_number().over(inside) == 1, "_before": before})
    rows = rows.withColumn("_amount", F.when(~F.col("_first"), amount(F.col("_before"))))
    sums = rows.groupBy(*by, bucket).agg(F.max_by(value, at).alias("_last"), F.sum("_amount").alias("_rest"), F.min_by(F.struct(*uses), at).alias("_row"))
    days = Window.partitionBy(*by).orderBy(bucket)
    sums = sums.withColumn("_carried", F.lag("_last").over(days)).select(*by, bucket, "_rest", "_carried", "_row.*")
    sums = sums.withColumn("_opening", F.coalesce(amount(F.col("_carried")), F.lit(0.0)))
    total = F.sum(F.coalesce("_rest", F.lit(0.0)) + F.col("_opening")).over(days.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, bucket, "_carried", (F.coalesce(total, F.lit(0.0)) + F.col("_opening")).alias("_base"))
    out = match(rows, sums, [*by, bucket])
    own = F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({into: F.col("_base") + F.coalesce(own, F.lit(0.0)), "_before": F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))})
    return out.drop("_first", "_amount", "_carried", "_base")


@dataclass(frozen=True)
class Source:
    """The right side of an as-of join: rows at the times `on`, of which `values` are taken; equal times are ordered by `tie`."""

    rows: DataFrame
    on: str
    values: Sequence[str]
    tie: str | None = None


def asof_join(left: DataFrame, left_on: str, *sources: Source, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each left row with the values of the last row of each source whose time is not later (exact matches count).

    All sides are tagged, united and dealt once by (key, UTC date); dates are sorted on their own, and what the last rows of
    the earlier dates give is carried to those with left rows. Nulls among the values stay nulls of that row.
    """
    rest = [c for c in left.columns if c not in by]
    kinds = {"_row": left.select(F.struct(*rest)).schema[0].dataType}
    for i, s in enumerate(sources):
        kinds |= {f"_value{i}": s.rows.select(F.struct(*s.values)).schema[0].dataType, f"_tie{i}": s.rows.select(F.col(s.tie) if s.tie else F.lit(0)).schema[0].dataType}

    def tagged(df: DataFrame, on: str, side: int, own: Mapping[str, Column]) -> DataFrame:
        filled = [own.get(k, F.lit(None).cast(t)).alias(k) for k, t in kinds.items()]
        return df.select(*by, F.col(on).alias("_at"), F.to_date(F.col(on)).alias("_day"), F.lit(side).alias("_side"), *filled)

    both = tagged(left, left_on, 1, {"_row": F.struct(*rest)})
    for i, s in enumerate(sources):
        both = both.unionByName(tagged(s.rows, s.on, 0, {f"_value{i}": F.struct(*s.values), f"_tie{i}": F.col(s.tie) if s.tie else F.lit(0)}))
    both = both.repartition(*by, "_day")  # both uses below read this one exchange
    ties = [f"_tie{i}" for i in range(len(sources))]
    inside = Window.partitionBy(*by, "_day").orderBy("_at", "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.max_by(f"_value{i}", F.when(F.col(f"_value{i}").isNotNull(), F.struct("_at", f"_tie{i}"))).alias(f"_last{i}") for i in range(len(sources))]
    last = both.groupBy(*by, "_day").agg(*latest, F.count("_row").alias("_left"))
    earlier = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_day", "_left", *[F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_carried{i}") for i in range(len(sources))]).where("_left > 0").drop("_left")
    found = both.withColumns({f"_found{i}": F.last(f"_value{i}", ignorenulls=True).over(inside) for i in range(len(sources))}).where("_side = 1")
    found = match(found, carried, [*by, "_day"]).withColumns({f"_found{i}": F.coalesce(f"_found{i}", f"_carried{i}") for i in range(len(sources))})
    taken = [F.col(f"_found{i}.{v}").alias(v) for i, s in enumerate(sources) for v in s.values]
    return found.select(*by, "_row.*", *taken).select(*left.columns, *[v for s in sources for v in s.values])
