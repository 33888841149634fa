"""Distributed selection, folds as ranges, as-of joins and carried scans against plain computations on small rows."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.contracts import ExperimentConfig, Fold, MonthKey, SplitConfig
from tickloom.functions import calendar as cal
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.windows import Source, asof_join, change_totals
from tickloom.operators import baselines, intraday, targets, validation


def interpolated(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if v[lo] == v[hi] else v[lo] * (1 - (at - lo)) + v[hi] * (at - lo)


def test_quantiles_of_groups(spark):
    rng = random.Random(4)
    make = [lambda: rng.uniform(-5, 5), lambda: float(rng.randrange(-2, 3)), lambda: rng.choice([2.0**k for k in range(-60, 60)]), lambda: -math.ldexp(1 - 2**-53, rng.randrange(-5, 40)), lambda: 1e-310 * rng.random(), lambda: 7.25, lambda: rng.gauss(0, 1e200)]
    rows = [(g, rng.choice(make)() if rng.random() > 0.05 else None, float(i % 7)) for g in ("a", "b", None, "one") for i in range(1 if g == "one" else 400)]
    rows += [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    ps = (0.0, 1 / 3, 0.5, 2 / 3, 0.99, 1.0)
    got = {r.g: r for r in exact_quantiles(df, ["g"], ["x", "y"], ps).collect()}
    assert set(got) == {"a", "b", None, "one", "none"} and got["none"].q_x is None
    for g, r in got.items():
        for m, found in ((1, r.q_x), (2, r.q_y)):
            own = [row[m] for row in rows if row[0] == g and row[m] is not None]
            if own:
                assert all(math.isclose(a, interpolated(own, p), rel_tol=1e-12, abs_tol=0) or a == interpolated(own, p) for a, p in zip(found, ps))
    whole = exact_quantiles(df, [], ["x"], (0.5,)).collect()
    assert len(whole) == 1 and math.isclose(whole[0].q_x[0], interpolated([r[1] for r in rows if r[1] is not None], 0.5), rel_tol=1e-12)
    assert exact_quantiles(df.limit(0), ["g"], ["x"], (0.5,)).count() == 0


def test_quantiles_of_odd_numbers(spark):
    values = [math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    found = exact_quantiles(df, [], ["x"], [k / 7 for k in range(8)]).first().q_x
    assert found[0] == -math.inf and found[1] == -5e-324 and found[2] == found[3] == 0 and found[4] == 5e-324 and found[5] == 1.7e308 and found[6] == math.inf and math.isnan(found[7])


def test_regimes_of_unknown_volatility(spark):
    rows = [("s", float(a) if a is not None else None, a is not None and int(a > 5 or 0), 0.5, 1.0) for a in (1, 2, 3, 4, 5, 6, 7, 8, 9)] + [("s", None, 1, 0.1, 0.2), ("s", math.nan, 0, 0.3, 0.4)]
    df = spark.createDataFrame([(s, a, int(t), m, n) for s, a, t, m, n in rows], "session_code string, atr double, target_peak_075_atr int, mfe_atr double, mae_atr double")
    got = {r.volatility_regime: r for r in baselines.by_regime(df, targets=("target_peak_075_atr",)).collect()}
    assert {k: r.observations for k, r in got.items()} == {"low": 3, "medium": 3, "high": 3, None: 2}
    assert got["low"].q33 == got[None].q33 and math.isclose(got["low"].q33, 1 + 8 / 3) and got[None].median_mfe_atr == pytest.approx(0.2)
    assert baselines.by_regime(df.limit(0), targets=("target_peak_075_atr",)).count() == 0


def observations(spark, rng, months, horizon):
    rows = []
    for y, m in months:
        for _ in range(rng.randrange(3, 9)):
            at = dt.datetime(y, m, 1) + dt.timedelta(minutes=rng.randrange(28 * 1440))
            rows.append((at.date(), at, at + dt.timedelta(minutes=rng.randrange(1, horizon))))
    first, last = dt.datetime(*months[0], 1), dt.datetime(*months[-1], 28)
    rows += [(first.date(), first, None), (last.date(), last, last + dt.timedelta(days=400)), (dt.date(1990, 1, 1), dt.datetime(1990, 1, 1), dt.datetime(1990, 1, 2)), (None, first, first)]
    return spark.createDataFrame(rows, "session_date date, observation_time_utc timestamp_ntz, target_horizon_end_utc timestamp_ntz")


@pytest.mark.parametrize("expanding,validation_months,test_months,horizon", [(True, 1, 1, 120), (False, 2, 3, 60 * 24 * 50), (True, 3, 1, 60 * 24 * 20)])
def test_fold_ranges_equal_splits(spark, expanding, validation_months, test_months, horizon):
    rng = random.Random(horizon)
    months = [(2024 + k // 12, k % 12 + 1) for k in range(3, 16)]
    df = observations(spark, rng, months, horizon)
    config = SplitConfig(minimum_train_months=4, validation_months=validation_months, test_months=test_months, embargo_minutes=600)
    folds = validation.walk_forward_folds([MonthKey(*m) for m in months], config, expanding)
    assigned = validation.assign_folds(df, folds, config)
    splits = validation.temporal_splits(df, folds, config)
    assert assigned.count() == df.count()
    assert sorted(map(tuple, validation.fold_summary(assigned, folds).collect())) == sorted(map(tuple, validation.split_summary(splits).collect()))
    key = ["fold", "observation_time_utc", "target_horizon_end_utc"]
    for part in validation.PARTS:
        a = sorted(map(str, validation.part_rows(assigned, part).select(*key).collect()))
        assert a == sorted(map(str, splits.where(F.col("kept") & (F.col("part") == part)).select(*key).collect())) and a


def test_folds_that_cannot_be_ranges(spark):
    rng = random.Random(1)
    months = [(2024, m) for m in range(1, 9)]
    df = observations(spark, rng, months, 100)
    folds = validation.walk_forward_folds([MonthKey(*m) for m in months])
    back = [Fold(1, folds[1].train, folds[1].validation, folds[1].test), Fold(2, folds[0].train, folds[0].validation, folds[0].test)] if len(folds) > 1 else [Fold(1, (MonthKey(2024, 3),), (MonthKey(2024, 2),), (MonthKey(2030, 1),))]
    for bad in (back, [], [Fold(1, *([(MonthKey(2030, 1),)] * 3))], [folds[0], Fold(5, folds[0].train, folds[0].validation, folds[0].test)]):
        with pytest.raises(ValueError):
            validation.assign_folds(df, bad)
    summary = validation.fold_summary(validation.assign_folds(df, folds[:1]), folds[:1])
    validation.check_folds(summary)
    with pytest.raises(ValueError):
        validation.check_folds(summary.withColumn("test_rows", F.lit(0)))


def test_splits_of_an_experiment_are_checked(spark):
    t0 = dt.datetime(2026, 8, 1)
    row = lambda i, part, kept=True, hours=1: (1, part, kept, t0 + dt.timedelta(hours=10 * i), t0 + dt.timedelta(hours=10 * i + hours))
    make = lambda *rows: spark.createDataFrame(list(rows), "fold int, part string, kept boolean, observation_time_utc timestamp_ntz, target_horizon_end_utc timestamp_ntz")
    validation.check_splits(make(row(0, "train"), row(1, "validation"), row(2, "test")))
    with pytest.raises(ValueError):
        validation.check_splits(make(row(0, "train"), row(1, "validation", False), row(2, "test")))
    with pytest.raises(AssertionError):
        validation.check_splits(make(row(0, "train", hours=12), row(1, "validation"), row(2, "test")))
    days = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(days=d),) for d in range(40)], "session_date date")
    for bad in (days, days.limit(3)):
        with pytest.raises(ValueError):
            validation.single_month_split(bad)


def test_asof_of_two_sources(spark):
    rng = random.Random(8)
    day = lambda: dt.datetime(2026, 8, rng.choice([1, 2, 5, 9])) + dt.timedelta(minutes=rng.randrange(1440))
    keys = ["A", "B", None]
    left = [(rng.choice(keys), day() if rng.random() > 0.05 else None, i) for i in range(120)]
    one = [(rng.choice(keys), day(), rng.randrange(3), rng.choice([None, 1.0, 2.0])) for _ in range(40)]
    two = [("A", day(), i) for i in range(15)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    sources = Source(frame([(k, t, s * 1000 + i, v) for i, (k, t, s, v) in enumerate(one)], "symbol string, u timestamp_ntz, seq int, v double"), "u", ["seq", "v"], tie="seq"), Source(frame(two, "symbol string, w timestamp_ntz, x int"), "w", ["w", "x"])
    got = {r.i: (r.seq, r.v, r.w, r.x) for r in asof_join(frame(left, "symbol string, t timestamp_ntz, i int"), "t", *sources).collect()}
    for k, t, i in left:
        a = max(((u, s * 1000 + j, v) for j, (key, u, s, v) in enumerate(one) if key == k and t is not None and u <= t), key=lambda r: r[:2], default=None)
        b = max(((w, x) for key, w, x in two if key == k and t is not None and w <= t), default=None)
        assert got[i] == ((a[1], a[2]) if a else (None, None)) + (b or (None, None)), i
    assert asof_join(frame(left, "symbol string, t timestamp_ntz, i int").limit(0), "t", *sources).count() == 0


def test_change_totals_carry_over_days(spark):
    rng = random.Random(3)
    rows = [(k, dt.date(2026, 8, 1 + d), i, float(rng.randrange(5)), float(rng.randrange(1, 4))) for k in ("A", "B") for i, d in enumerate(sorted(rng.choice([0, 1, 4]) for _ in range(25)))]
    df = spark.createDataFrame(rows, "symbol string, day date, i int, price double, w double").repartition(4)
    got = change_totals(df, "price", lambda before: F.signum(F.col("price") - before) * F.col("w"), ["price", "w"], "total", ["i"], "day").collect()
    for k in ("A", "B"):
        total, before = 0.0, None
        for r in sorted((r for r in got if r.symbol == k), key=lambda r: r.i):
            total += 0.0 if before is None else float(np.sign(r.price - before)) * r.w
            assert (r.total, r._before) == (total, before)
            before = r.price
    assert len(got) == len(rows)
    plan = change_totals(df, "price", lambda before: F.signum(F.col("price") - before) * F.col("w"), ["price", "w"], "total", ["i"], "day")
    assert set(plan.columns) == {"symbol", "day", "i", "price", "w", "_before", "total"}


def plain_targets(path, at, close, atr, minutes, step, config):
    """What the bars of one path say, one after another."""
    if len(path) != minutes // step:
        return "incomplete_horizon"
    if [t for t, _, _ in path] != [at + dt.timedelta(minutes=step * k) for k in range(minutes // step)]:
        return "m1_gap"
    high, low = max(p[1] for p in path), min(p[2] for p in path)
    peak, trough = next(k for k, p in enumerate(path) if p[1] == high), next(k for k, p in enumerate(path) if p[2] == low)
    up = next((k for k, p in enumerate(path) if p[1] >= close + config.thresholds.barrier * atr), None)
    down = next((k for k, p in enumerate(path) if p[2] <= close - config.adverse_barrier_atr * atr), None)
    touch = min((k for k in (up, down) if k is not None), default=None)
    worst = min(p[2] for p in path[: peak + 1])
    label = 0 if touch is None else None if up == down else 1 if down is None or (up is not None and up < down) else -1
    return high, low, (peak + 1) * step, (trough + 1) * step, max(close - worst, 0.0), label, None if touch is None else (touch + 1) * step


@pytest.mark.parametrize("horizon,step", [(60, 5), (12, 1), (4, 4)])
def test_targets_by_walking_the_paths(spark, horizon, step):
    rng, t0 = random.Random(horizon), dt.datetime(2026, 8, 3)
    price, bars = {"A": 100.0, "B": 50.0}, []
    for s in price:
        for k in range(0, 1500, step):
            price[s] += rng.choice([-1, -0.5, 0, 0, 0.5, 1])
            t = t0 + dt.timedelta(minutes=k)
            if rng.random() < 0.02:
                continue
            if rng.random() < 0.01:
                t += dt.timedelta(seconds=rng.choice([1, 30]))
            bars += [(s, t, price[s] + rng.choice([0.5, 1]), price[s] - rng.choice([0.5, 1]))] * (2 if rng.random() < 0.01 else 1)
    obs = [(s, "full_day", t0.date(), t0 + dt.timedelta(minutes=step * k), float(rng.randrange(45, 105)) if rng.random() < 0.5 else price[s], rng.choice([1.0, 2.0, 6.0])) for s in price for k in rng.sample(range(1400 // step - horizon // step), min(120, 1400 // step - horizon // step))]
    config = ExperimentConfig(horizon_minutes=horizon, path_minutes=step)
    frame = spark.createDataFrame(obs, "symbol string, session_code string, session_date date, observation_time_utc timestamp_ntz, close double, atr double").repartition(3)
    path = spark.createDataFrame(bars, "symbol string, timestamp_utc timestamp_ntz, high double, low double").repartition(3)
    day = cal.SESSIONS["full_day"]
    rows = targets.peak_targets(frame.withColumn("session_date", F.to_date(F.col("observation_time_utc") - F.expr("INTERVAL 5 HOURS"))), path, day, config, drop_invalid=False).collect()
    assert len(rows) == len(obs)
    seen = set()
    for r in rows:
        if r.target_exclusion_reason == "horizon_outside_session":
            continue
        end = r.observation_time_utc + dt.timedelta(minutes=horizon)
        own = sorted(b[1:] for b in bars if b[0] == r.symbol and r.observation_time_utc <= b[1] < end)
        want = plain_targets(own, r.observation_time_utc, r.close, r.atr, horizon, step, config)
        if isinstance(want, str):
            assert r.target_exclusion_reason == want and r.future_high is None and r.mfe_atr is None and r.triple_barrier_label is None and r.first_barrier_touch_minutes is None
            seen.add(want)
        else:
            assert (r.future_high, r.future_low, r.time_to_peak_minutes, r.time_to_trough_minutes, r.adverse_before_peak_points, r.triple_barrier_label, r.first_barrier_touch_minutes) == want
            seen.add(want[5])
    assert {0, 1, -1} <= seen and (step == horizon or "incomplete_horizon" in seen)


def test_filled_minutes(spark):
    t = lambda m: dt.datetime(2026, 8, 3, 23, 50) + dt.timedelta(minutes=m)
    rows = [("A", t(0), 1.0, 3.0, 0.5, 2.0, 5, 20, 9), ("A", t(3), 2.0, 2.5, 1.5, 2.25, 6, 20, 9), ("A", t(14), 4.0, 4.0, 4.0, 4.0, 1, 20, 9), ("B", t(2), 7.0, 7.0, 7.0, 7.0, 1, 20, 9)]
    df = spark.createDataFrame(rows, "symbol string, timestamp_utc timestamp_ntz, open double, high double, low double, close double, volume long, spread int, real_volume long")
    got = {(r.symbol, r.timestamp_utc): r for r in intraday.fill_minutes(df).collect()}
    assert len(got) == 16 and set(got) == {("A", t(m)) for m in range(15)} | {("B", t(2))}
    assert (got["A", t(1)].high, got["A", t(1)].volume, got["A", t(3)].high, got["A", t(13)].low, got["A", t(14)].volume) == (2.0, 0, 2.5, 2.25, 1)
