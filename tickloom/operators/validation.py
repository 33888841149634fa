"""Leak-free temporal splits: walk-forward folds by month, purged and embargoed, and a split of a single month."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.contracts import Fold, MonthKey, SplitConfig

PARTS = ("train", "validation", "test")
MONTH_DAYS = 33  # session dates of a month at most: a date more at each end, by the local zone


def month_key(column: str = "session_date") -> Column:
    return F.date_format(column, "yyyy-MM")


def available_months(df: DataFrame) -> DataFrame:
    return df.select(F.year("session_date").alias("year"), F.month("session_date").alias("month")).distinct()


def walk_forward_folds(months: Iterable[MonthKey], config: SplitConfig = SplitConfig(), expanding: bool = True) -> tuple[Fold, ...]:
    own, train, after = sorted(set(months)), config.minimum_train_months, config.validation_months + config.test_months
    if len(own) < train + after:
        raise ValueError(f"{len(own)} months, {train + after} needed")
    out = []
    for number, at in enumerate(range(train, len(own) - after + 1), 1):
        mid = at + config.validation_months
        out.append(Fold(number, tuple(own[0 if expanding else at - train : at]), tuple(own[at:mid]), tuple(own[mid : at + after])))
    return tuple(out)


def fold_table(spark, folds: Iterable[Fold]) -> DataFrame:
    """(fold, part, month): one row for each month of each part."""
    rows = [(f.number, part, m.label) for f in folds for part, months in zip(PARTS, (f.train, f.validation, f.test)) for m in months]
    return spark.createDataFrame(rows, "fold int, part string, month string")


def _purged(assigned: DataFrame, embargo_minutes: int) -> DataFrame:
    """Adds `kept` to rows with fold and part. Boundaries are the first validation and test times before any purge."""
    at, end, wait = F.col("observation_time_utc"), F.col("target_horizon_end_utc"), F.expr(f"INTERVAL {embargo_minutes} MINUTES")
    first = lambda part: F.min(F.when(F.col("part") == part, at))
    bounds = assigned.groupBy("fold").agg(first("validation").alias("_v"), first("test").alias("_t"))  # a row for each fold
    v, t = F.col("_v"), F.col("_t")
    kept = (F.when(F.col("part") == "train", end <= v - wait).when(F.col("part") == "validation", (at >= v + wait) & (end <= t - wait)).otherwise(at >= t + wait))
    return assigned.join(F.broadcast(bounds), "fold").withColumn("kept", F.coalesce(kept, F.lit(False))).drop("_v", "_t")


def temporal_splits(df: DataFrame, folds: Iterable[Fold], config: SplitConfig = SplitConfig()) -> DataFrame:
    """df once for each fold it takes part in, with fold, part and kept (false: purged or embargoed)."""
    months = F.broadcast(fold_table(df.sparkSession, folds))  # folds times months
    assigned = df.withColumn("month", month_key()).join(months, "month").drop("month")
    return _purged(assigned, config.embargo_minutes)


def _month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def _at_month(table: Mapping[int, Column], month: Column) -> Column:
    """The table's value for a month number, null beyond the table; one look into an array."""
    lo, hi = min(table), max(table)
    return F.when(month.between(lo, hi), F.element_at(F.array(*[table.get(m, F.lit(None)) for m in range(lo, hi + 1)]), month - lo + 1))


def _passed(times: Sequence[dt.datetime], at: Column, inclusive: bool) -> Column:
    """How many of the rising times lie before `at`, or at it too; only those of its month are compared."""
    number = lambda t: t.year * 12 + t.month
    lo, hi = number(times[0]), number(times[-1])
    own = {m: [t for t in times if number(t) == m] for m in range(lo, hi + 1)}
    literal = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    inside = _at_month({m: F.array(*map(literal, ts)).cast("array<timestamp_ntz>") for m, ts in own.items()}, _month_number(at))
    before = _at_month({m: F.lit(sum(number(t) < m for t in times)) for m in own}, _month_number(at))
    within = before + F.size(F.filter(inside, (lambda t: t <= at) if inclusive else (lambda t: t < at)))
    return F.when(_month_number(at) < lo, 0).when(_month_number(at) > hi, len(times)).otherwise(within)


def assign_folds(df: DataFrame, folds: Sequence[Fold], config: SplitConfig = SplitConfig()) -> DataFrame:
    """df with the folds of each row as ranges of numbers, each row once.

    `<part>_first` and `<part>_last`: the folds in which the row is in the part and neither purged nor embargoed, null if
    there are none; `<part>_in_first` and `<part>_in_last`: the folds whose part holds its month. Folds move forward in
    time, so every condition on a row holds for a range of them: a row is in train from the fold on whose validation
    begins late enough, and so forth. ValueError for folds that do not, or with a part without rows.
    """
    folds = sorted(folds, key=lambda f: f.number)
    if not folds or [f.number for f in folds] != list(range(folds[0].number, folds[0].number + len(folds))):
        raise ValueError("folds must be numbered without gaps")
    base, wait = folds[0].number, dt.timedelta(minutes=config.embargo_minutes)
    month = _month_number(F.col("session_date"))
    starts = {r.m: r.at for r in df.groupBy(month.alias("m")).agg(F.min("observation_time_utc").alias("at")).collect()}  # a row for each month
    number = lambda m: m.year * 12 + m.month
    held: dict[str, dict[int, list[int]]] = {p: {} for p in PARTS}
    begins: dict[str, list[dt.datetime]] = {p: [] for p in PARTS}
    for f in folds:
        for p, months in zip(PARTS, (f.train, f.validation, f.test)):
            for m in months:
                held[p].setdefault(number(m), []).append(f.number)
            at = [starts[number(m)] for m in months if starts.get(number(m))]
            if not at:
                raise ValueError(f"fold {f.number} has no rows in {p}")
            begins[p].append(min(at))
    if any(x != sorted(x) for x in begins.values()) or any(n != list(range(n[0], n[-1] + 1)) for p in held.values() for n in p.values()):
        raise ValueError("folds must move forward in time")
    v, t = begins["validation"], begins["test"]
    at, end = F.col("observation_time_utc"), F.col("target_horizon_end_utc")
    from_fold = lambda cuts, c: base + _passed(cuts, c, False)  # noqa: E731  # the first whose cut is not before c
    upto_fold = lambda cuts, c: base - 1 + _passed(cuts, c, True)  # noqa: E731  # the last whose cut is not after c
    limits = {"train": (from_fold([x - wait for x in v], end), None), "validation": (from_fold([x - wait for x in t], end), upto_fold([x + wait for x in v], at)),
              "test": (None, upto_fold([x + wait for x in t], at))}
    out = df.withColumns({f"{p}_in_{side}": _at_month({m: F.lit(n[i]) for m, n in held[p].items()}, month) for p in PARTS for side, i in (("first", 0), ("last", -1))})
    for p, (low, high) in limits.items():
        first, last = F.col(f"{p}_in_first"), F.col(f"{p}_in_last")
        known = first.isNotNull()  # greatest and least skip nulls
        for c in (low, high):
            known = known & c.isNotNull() if c is not None else known
        first, last = first if low is None else F.greatest(first, low), last if high is None else F.least(last, high)
        out = out.withColumns({f"{p}_first": F.when(known & (first <= last), first).cast("int"), f"{p}_last": F.when(known & (first <= last), last).cast("int")})
    return out


def part_rows(assigned: DataFrame, part: str) -> DataFrame:
    """The rows kept in a part, with their fold; a row comes once for each fold that holds it there."""
    return assigned.where(F.col(f"{part}_first").isNotNull()).withColumn("fold", F.explode(F.sequence(f"{part}_first", f"{part}_last")))


def fold_summary(assigned: DataFrame, folds: Iterable[Fold]) -> DataFrame:
    """`split_summary` of assigned rows: counts of the ranges that occur, then running sums over the folds of what begins and ends."""
    ranges = [f"{p}_{i}{side}" for p in PARTS for i in ("", "in_") for side in ("first", "last")]
    counted = assigned.groupBy(*ranges).agg(F.count("*").alias("n"))
    changes = F.array(*[F.struct(F.lit(f"{p}_{i}").alias("of"), c.alias("fold"), n.alias("n")) for p in PARTS for i in ("", "in_")
                        for c, n in ((F.col(f"{p}_{i}first"), F.col("n")), (F.col(f"{p}_{i}last") + 1, -F.col("n")))])
    changed = counted.select(F.explode(changes).alias("c")).select("c.*").where("fold IS NOT NULL")
    sums = changed.groupBy("fold").agg(*[F.sum(F.when(F.col("of") == f"{p}_{i}", F.col("n"))).alias(f"{p}_{i}") for p in PARTS for i in ("", "in_")])
    every = assigned.sparkSession.createDataFrame([(f.number,) for f in folds], "fold int").join(sums, "fold", "left")
    upto = Window.partitionBy(F.lit(0)).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)  # a row for each fold
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    return every.select("fold", *[total(f"{p}_").alias(f"{p}_rows") for p in PARTS], *[(total(f"{p}_in_") - total(f"{p}_")).alias(f"{p}_lost") for p in PARTS])


def check_folds(summary: DataFrame) -> None:
    """ValueError for a fold with an empty part."""
    empty = summary.where(" OR ".join(f"{p}_rows = 0" for p in PARTS)).select("fold").limit(10).collect()
    if empty:
        raise ValueError(f"folds with an empty part: {[r.fold for r in empty]}")


def split_summary(splits: DataFrame) -> DataFrame:
    """A row for each fold with rows kept and lost in each part; a fold with an empty part is a caller's error."""
    kept, part = F.col("kept"), F.col("part")
    out = splits.groupBy("fold").agg(*[F.count_if(kept & (part == p)).alias(f"{p}_rows") for p in PARTS], *[F.count_if(~kept & (part == p)).alias(f"{p}_lost") for p in PARTS])
    return out


def check_splits(splits: DataFrame) -> None:
    """ValueError for an empty part, AssertionError if a part still reaches into the next."""
    at, end, kept = F.col("observation_time_utc"), F.col("target_horizon_end_utc"), F.col("kept")
    of = lambda p: kept & (F.col("part") == p)
    rows = splits.groupBy("fold").agg(
        *[F.count_if(of(p)).alias(p) for p in PARTS], F.max(F.when(of("train"), end)).alias("a"), F.min(F.when(of("validation"), at)).alias("b"),
        F.max(F.when(of("validation"), end)).alias("c"), F.min(F.when(of("test"), at)).alias("d"))
    if rows.where("train = 0 OR validation = 0 OR test = 0").limit(1).count():
        raise ValueError("a fold has an empty part")
    if rows.where("a > b OR c > d").limit(1).count():
        raise AssertionError("parts overlap after the purge")


def single_month_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, embargo_minutes: int = 60) -> DataFrame:
    """Parts by whole session dates (fold 0), purged and embargoed like a fold; at least 5 dates."""
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("fractions must be positive and leave some for the test")
    days = sorted(r[0] for r in df.select("session_date").distinct().limit(MONTH_DAYS + 1).collect())
    if not 5 <= len(days) <= MONTH_DAYS:
        raise ValueError(f"{len(days)} session dates or more, 5 to {MONTH_DAYS} are those of a month")
    a = max(1, int(len(days) * train))
    b = min(max(a + 1, int(len(days) * (train + validation))), len(days) - 1)
    day = F.col("session_date")
    part = F.when(day < F.lit(days[a]), "train").when(day < F.lit(days[b]), "validation").otherwise("test")
    return _purged(df.withColumns({"fold": F.lit(0), "part": part}), embargo_minutes)
