import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.contracts import ExperimentConfig, ModelConfig, MonthKey, SplitConfig, Thresholds
from tickloom.functions import calendar as cal
from tickloom.functions.windows import Source, asof_join, in_blocks, rolling, series
from tickloom.operators import baselines, dataset, evaluation, features, models, quality, targets, validation
from tickloom.plans import products
from tickloom.sources import ingest, lake

START = dt.datetime(2026, 7, 31, 5)


def bars(spark, minutes, n, start=START):
    rows = []
    for i in range(n):
        o = 100 + 0.015 * i + 0.75 * math.sin(i / 11)
        c = o + 0.2 * math.sin(i / 3.5)
        rows.append(("SYN", start + dt.timedelta(minutes=minutes * i), o, max(o, c) + 0.35, min(o, c) - 0.35, c, 100 + i % 70, 20, 0))
    df = spark.createDataFrame(rows, "symbol string, timestamp_utc timestamp_ntz, open double, high double, low double, close double, volume long, spread int, real_volume long")
    return lake.normalise_bars(df)


@pytest.fixture(scope="module")
def market(spark):
    days = 8
    return {"m1": bars(spark, 1, days * 1440).cache(), "m15": bars(spark, 15, days * 96).cache(), "h1": bars(spark, 60, days * 24).cache()}


def test_sessions():
    assert cal.SESSIONS["asia"].duration == 240 and cal.resolve_session().code == "new_york"
    assert cal.resolve_session("custom", "22:00", "02:00").crosses_midnight
    for bad in (("custom", "07:00", "07:00"), ("nowhere", None, None), ("custom", "25:00", "01:00")):
        with pytest.raises(ValueError):
            cal.resolve_session(*bad)


def test_overnight_and_full_day(spark):
    times = [dt.datetime(2026, 8, 3, 21, 45), dt.datetime(2026, 8, 3, 22), dt.datetime(2026, 8, 4, 0, 30), dt.datetime(2026, 8, 4, 2)]
    df = spark.createDataFrame([(t,) for t in times], "timestamp_cot timestamp_ntz")
    got = cal.filter_session(df, cal.SessionWindow("o", 1320, 120)).orderBy("timestamp_cot").collect()
    assert [r.minute_of_session for r in got] == [0, 150] and len({r.session_date for r in got}) == 1
    one = cal.filter_session(spark.createDataFrame([(dt.datetime(2026, 8, 3, 8, 15),)], "timestamp_cot timestamp_ntz"), cal.SESSIONS["full_day"]).first()
    assert one.minute_of_session == 495 and one.session_progress == 495 / 1440


def test_periods():
    lo, hi = cal.day_range_utc(dt.date(2026, 5, 1), dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc))
    assert (lo.hour, hi - lo) == (5, dt.timedelta(days=1))
    with pytest.raises(ValueError):
        cal.day_range_utc(dt.date(2026, 6, 3), dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc))
    with pytest.raises(ValueError):
        cal.closed_months(dt.date(2026, 6, 1), dt.date(2026, 6, 1), dt.date(2026, 6, 15))
    assert cal.closed_months(dt.date(2026, 1, 1), dt.date(2026, 2, 1), dt.date(2026, 6, 15)).end == dt.date(2026, 3, 1)


def test_quality(spark, market):
    quality.validate_bars(market["h1"])
    with pytest.raises(ValueError, match="OHLC"):
        quality.validate_bars(market["h1"].withColumn("high", F.lit(50.0)))
    with pytest.raises(ValueError, match="duplicates"):
        quality.reconcile_duplicates(market["h1"].unionByName(market["h1"].limit(1).withColumn("volume", F.lit(1).cast("long"))))
    assert quality.reconcile_duplicates(market["h1"].unionByName(market["h1"])).count() == market["h1"].count()


def test_lake_round_trip(spark, market, tmp_path):
    root = f"file://{tmp_path}/lake"
    lake.write_lake(market["h1"], root, "h1", "SYN")
    assert lake.audit(spark, root, "h1", "SYN") == market["h1"].count()
    day = cal.Period(dt.date(2026, 8, 1), dt.date(2026, 8, 2))
    got = lake.read_lake(spark, root, "h1", "SYN", day)
    assert got.count() == 24 and "PartitionFilters: [isnotnull(symbol" in got._jdf.queryExecution().explainString(got._jdf.queryExecution().mode() if False else spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    with pytest.raises(FileNotFoundError):
        lake.load_context(spark, root, "NONE", day, ("h1",))
    with pytest.raises(TypeError):
        lake.normalise_bars(market["h1"].withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp")))


def test_context_and_audit(spark, market, tmp_path):
    period, root = cal.Period(dt.date(2026, 8, 3), dt.date(2026, 8, 6)), f"file://{tmp_path}/lake"
    h1 = market["h1"]
    lake.write_lake(h1.unionByName(h1), root, "h1", "SYN")
    found = lake.load_context(spark, root, "SYN", period, ("h1",))
    assert found.removed == {"h1": 72}
    files = {"h1": lake.stored_files(spark, root, "h1", "SYN", period)}
    row = lake.summarise(found, files).first()
    paths = [p for d in (3, 4, 5) for p in (tmp_path / f"lake/h1/symbol=SYN/year=2026/month=8/day={d}").glob("*.parquet")]
    assert row.rows == found["h1"].count() == 72 and row.files == len(paths) and row.file_bytes == sum(p.stat().st_size for p in paths) and row.memory_bytes > 72 * 60
    chunks = lake.column_chunks(spark, root, "h1", "SYN")
    assert chunks.where("codec <> 'ZSTD' OR NOT has_statistics").count() == 0 and chunks.count() % 8 == 0
    assert lake.audit(spark, root, "h1", "SYN") == 2 * h1.count()
    for name, bad in (("differs", h1.unionByName(h1.withColumn("close", F.col("close") + 0.01))), ("unsound", h1.withColumn("high", F.col("low") - 1))):
        lake.write_lake(bad, f"{root}-{name}", "h1", "SYN")
        with pytest.raises(ValueError):
            lake.load_context(spark, f"{root}-{name}", "SYN", period, ("h1",))
    spark.read.parquet(f"{root}/h1").write.option("compression", "snappy").partitionBy("symbol", "year", "month", "day").parquet(f"{root}-snappy/h1")
    with pytest.raises(AssertionError, match="another codec"):
        lake.audit(spark, f"{root}-snappy", "h1", "SYN")


def test_ticks_and_broker_bars_in_the_lake(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    at = dt.datetime(2026, 8, 4, 12)
    ticks = spark.range(500).select((F.lit(1_785_844_800_000) + F.col("id") * 1000).alias("time_msc"), F.lit(1.0).alias("bid"), (1.5 + F.col("id")).alias("ask"))
    assert ingest.ingest({"ticks": ticks}, root, "SYN", at, at + dt.timedelta(minutes=5))[0].rows == 300
    got = lake.read_lake(spark, root, "ticks", "SYN", cal.Period(dt.date(2026, 8, 4), dt.date(2026, 8, 5)))
    assert got.count() == 300 and got.agg(F.min("timestamp_utc"), F.max("ask")).first() == (at, 300.5)
    raw = spark.createDataFrame([(1_785_844_800 + 60 * i, 2.0, 3.0, 1.0, 2.5, 7, 1, 0) for i in range(4)], "time long, open double, high double, low double, close double, tick_volume long, spread int, real_volume long")
    assert ingest.ingest({"M1": raw}, root, "SYN", at, at + dt.timedelta(minutes=3))[0].rows == 3
    assert lake.read_lake(spark, root, "m1", "SYN").agg(F.sum("volume")).first()[0] == 21
    with pytest.raises(RuntimeError):
        ingest.ingest({"m1": raw}, root, "SYN", at + dt.timedelta(days=1), at + dt.timedelta(days=2))


def test_broker_rows(spark):
    ticks = spark.createDataFrame([(1_700_000_000_123, 1.0, 1.5)], "time_msc long, bid double, ask double")
    assert lake.ticks_from_broker(ticks).first().timestamp_utc.microsecond == 123000
    with pytest.raises(ValueError):
        lake.ticks_from_broker(ticks.withColumn("bid", F.lit(9.0)))


def test_asof_ties_and_carry(spark):
    day = lambda d, h: dt.datetime(2026, 8, d, h)
    left = spark.createDataFrame([("A", day(1, 0)), ("A", day(1, 5)), ("A", day(4, 1)), ("B", day(1, 5))], "symbol string, t timestamp_ntz")
    right = spark.createDataFrame([("A", day(1, 5), 1, 10), ("A", day(1, 5), 2, 20), ("A", day(2, 3), 1, 30)], "symbol string, u timestamp_ntz, seq int, v int")
    got = asof_join(left, "t", Source(right, "u", ["v"], tie="seq")).orderBy("symbol", "t").collect()
    assert [r.v for r in got] == [None, 20, 30, None]


def test_research_invariants(spark, market):
    made = products.research_dataset(market["m15"], market["h1"], market["m1"], cal.SESSIONS["new_york"])
    data = made.data.cache()
    assert data.count() > 10 and len(data.columns) == 69
    assert data.where("target_horizon_end_utc > session_end_utc OR target_peak_100_atr > target_peak_075_atr OR target_peak_075_atr > target_peak_050_atr").count() == 0
    other = products.research_dataset(market["m15"], market["h1"], market["m1"], cal.SESSIONS["london"])
    assert dataset.combine(made, other).data.count() == data.count() + other.data.count()
    with pytest.raises(ValueError):
        dataset.combine(made, made)
    for bad in (("atr", "atr"), ("target_x",), ("mfe_atr",)):
        with pytest.raises(ValueError):
            dataset.check_features(bad)


def _barrier(spark, path, policy="exclude"):
    t0 = dt.datetime(2026, 8, 3, 12, 15)
    obs = spark.createDataFrame([("SYN", "full_day", dt.date(2026, 8, 3), t0, 100.0, 1.0)], "symbol string, session_code string, session_date date, observation_time_utc timestamp_ntz, close double, atr double")
    own = spark.createDataFrame([("SYN", t0 + dt.timedelta(minutes=m), float(h), float(lo)) for m, h, lo in path], "symbol string, timestamp_utc timestamp_ntz, high double, low double")
    config = ExperimentConfig(horizon_minutes=4, ambiguous_policy=policy)
    return targets.peak_targets(obs, own, cal.SESSIONS["full_day"], config, drop_invalid=False).first()


def test_triple_barrier_cases(spark):
    flat = [(m, 100.1, 99.9) for m in range(4)]
    assert _barrier(spark, flat).triple_barrier_label == 0
    up = _barrier(spark, [(0, 100.1, 99.9), (1, 100.8, 99.9), (2, 100.1, 99.0), (3, 100, 99.9)])
    assert (up.triple_barrier_label, up.first_barrier_touch_minutes, up.time_to_peak_minutes, up.target_peak_075_atr) == (1, 2, 2, 1)
    assert _barrier(spark, [(0, 100.1, 99.4), *flat[1:]]).triple_barrier_label == -1
    both = [(0, 101, 99), *flat[1:]]
    tie = _barrier(spark, both)
    assert tie.target_ambiguous and tie.target_exclusion_reason == "ambiguous_barrier" and tie.triple_barrier_label is None
    assert _barrier(spark, both, "conservative").triple_barrier_label == -1
    assert _barrier(spark, flat[:3]).target_exclusion_reason == "incomplete_horizon"
    assert _barrier(spark, [flat[0], flat[1], (1.5, 100, 99.9), flat[3]]).target_exclusion_reason == "m1_gap"
    with pytest.raises(NotImplementedError):
        _barrier(spark, flat, "resolve_with_ticks")


def test_folds_and_contracts():
    months = [MonthKey(2026, m) for m in range(1, 11)]
    folds = validation.walk_forward_folds(months)
    assert len(folds) == 3 and folds[0].validation == (MonthKey(2026, 7),) and len(validation.walk_forward_folds(months, expanding=False)[2].train) == 6
    with pytest.raises(ValueError):
        validation.walk_forward_folds(months[:5])
    for bad in (lambda: SplitConfig(minimum_train_months=2), lambda: Thresholds((1.0, 0.5)), lambda: Thresholds(()), lambda: Thresholds((0.0, 1.0)), lambda: Thresholds((0.5,), 1), lambda: ModelConfig(target="y"), lambda: ModelConfig(c_values=())):
        with pytest.raises(ValueError):
            bad()


def test_model_and_evaluation(spark):
    rows = []
    for p in range(160):
        a, b, c, at = math.sin(p / 6), math.cos(p / 10), (p % 8) / 8, dt.datetime(2026, 8, 1, 12) + dt.timedelta(minutes=15 * p)
        part = "train" if p < 95 else "validation" if p < 125 else "test"
        rows.append((f"synthetic-{p:05d}", at, at + dt.timedelta(hours=1), "new_york", a, b, c, int(a + 0.7 * b + c > 0.35), part, p not in (92, 93, 94, 122, 123, 124)))  # whose hour reaches into the next part
    df = spark.createDataFrame(rows, "observation_id string, observation_time_utc timestamp_ntz, target_horizon_end_utc timestamp_ntz, session_code string, feature_a double, feature_b double, feature_c double, target_peak_075_atr int, part string, kept boolean")
    done = products.experiment(df, ("feature_a", "feature_b", "feature_c"), ModelConfig(c_values=(0.1, 10.0)))
    found = {r.source: r for r in done.evaluation["metrics"].collect()}
    assert found["model_probability"].brier < found["baseline_probability"].brier and found["model_probability"].rows == 35
    assert done.predictions.count() == 35 and models.coefficient_table(spark, done.model).count() == 3
    one_class = evaluation.long_form(done.predictions.where("actual_target = 1"))
    assert evaluation.ranking_metrics(one_class).where("roc_auc IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        evaluation.join_sources(done.predictions.select("observation_id", "actual_target"), done.predictions.select("observation_id", "baseline_probability").limit(3))


def test_warm_up(spark, market):
    raw = features.feature_frame(market["m15"], market["h1"], cal.SESSIONS["full_day"], drop_incomplete=False)
    first = raw.where("volume_zscore IS NOT NULL").agg(F.min("timestamp_utc")).first()[0]
    assert first == START + dt.timedelta(minutes=15 * 32)
    assert baselines.atr_terciles(raw.where("atr IS NOT NULL")).count() == 1


def test_stream_matches_batch(spark, tmp_path):
    from tickloom.streaming.bars import tick_bars

    rows = [("SYN", dt.datetime(2026, 8, 3, 12, m, s), 100.0 + m, 100.5 + m, 1.0, m * 60 + s) for m in range(3) for s in (1, 30)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, bid double, ask double, volume double, seq long")
    df.write.parquet(f"{tmp_path}/t")
    stream = tick_bars(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/t"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("bars_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, tick_bars(df).collect()))


def test_target_contract(spark):
    t0 = dt.datetime(2026, 8, 3, 12, 15)
    schema = "symbol string, session_code string, session_date date, observation_time_utc timestamp_ntz, close double, atr double"
    row = lambda code, minutes=0: ("SYN", code, t0.date(), t0 + dt.timedelta(minutes=minutes), 100.0, 1.0)
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    targets.check_observations(make(row("full_day"), row("full_day", 15)), cal.SESSIONS["full_day"])
    for bad in (make(), make(row("london")), make(row("full_day"), row("full_day")), make(row("full_day"), row(None)), make(row("full_day")).drop("atr")):
        with pytest.raises(ValueError):
            targets.check_observations(bad, cal.SESSIONS["full_day"])


def test_fingerprint_separates_features_and_targets():
    c = ExperimentConfig()
    assert dataset.fingerprint(c, ("a", "b"), ("c",)) != dataset.fingerprint(c, ("a",), ("b", "c"))
    assert dataset.fingerprint(c, ("a",), ("b",)) == dataset.fingerprint(c, ("a",), ("b",))


def test_logistic_model_by_newton_of_its_own(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.1] + [0, 3, -1]
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] + 0.3 * x[:, 1] - 1)))).astype(int)
    fold = np.repeat([1, 2], 120)
    part = np.where(np.arange(240) % 120 < 80, "train", "validation")
    rows = [(int(f), str(p), True, int(t), *map(float, v)) for f, p, t, v in zip(fold, part, y, x)]
    splits = spark.createDataFrame(rows, "fold int, part string, kept boolean, target_peak_075_atr int, a double, b double, c double").repartition(5)
    for balanced in (False, True):
        found = models.train_folds(splits, ("a", "b", "c"), ModelConfig(c_values=(0.05, 2.0), balanced=balanced))
        for f in (1, 2):
            at = (fold == f) & (part == "train")
            z = np.column_stack([(x[at] - x[at].mean(axis=0)) / x[at].std(axis=0), np.ones(at.sum())])
            rate, c = y[at].mean(), found[f].c
            weight = np.where(y[at] == 1, 0.5 / rate, 0.5 / (1 - rate)) if balanced else np.ones(at.sum())
            w = np.zeros(4)
            for _ in range(20000):  # plain gradient descent
                w -= 0.02 / max(1, c) * (w + c * z.T @ (weight * (1 / (1 + np.exp(-z @ w)) - y[at])))
            assert np.allclose(w, [*found[f].coefficients, found[f].intercept], atol=1e-6)
            assert found[f].c == min(found[f].candidates, key=lambda r: (r[1], r[2], r[0]))[0] and len(found[f].candidates) == 2
    for bad in (F.when(F.col("b") > 3, F.col("a")), F.lit(float("inf")), F.lit(float("nan"))):
        with pytest.raises(ValueError):
            models.train_folds(splits.withColumn("a", bad), ("a",))
    with pytest.raises(ValueError):
        models.train_folds(splits.withColumn("target_peak_075_atr", F.lit(1)), ("a",))


def test_windows_in_blocks_equal_whole_series(spark):
    at = [None, *[START + dt.timedelta(minutes=7 * i, days=3 * (i // 40)) for i in range(130)]]
    rows = [(s, t, float((i * 37) % 101)) for s in ("A", "B", None) for i, t in enumerate(at) if s != "B" or i < 9]
    df = spark.createDataFrame(rows, "symbol string, timestamp_utc timestamp_ntz, v double").repartition(5)

    def step(d, w):
        d = d.withColumn("change", F.col("v") - F.lag("v").over(w))
        return d.withColumns({"mean": rolling(F.avg, F.col("change"), 4, w), "top": rolling(F.max, F.col("v"), 5, w, prior=True)})

    want = sorted(map(str, step(df, series()).collect()))
    for size in (5, 7, 64, 1000):
        assert sorted(map(str, in_blocks(df, step, 5, block_rows=size).collect())) == want
    assert in_blocks(df.limit(0), step, 5).count() == 0
    with pytest.raises(ValueError):
        in_blocks(df, step, 6, block_rows=5)


def test_bars_of_a_feature_frame_are_checked(spark, market):
    day = cal.SESSIONS["full_day"]
    whole = features.feature_frame(market["m15"], market["h1"], day)
    assert whole.count() == features.feature_frame(market["m15"], market["h1"], day, check=False).count() > 0
    for bad in (market["m15"].limit(0), market["m15"].unionByName(market["m15"].limit(2)), market["m15"].drop("spread"), market["m15"].withColumn("symbol", F.when(F.col("volume") > 100, F.col("symbol")))):
        with pytest.raises(ValueError):
            features.feature_frame(bad, market["h1"], day)
        with pytest.raises(ValueError):
            features.feature_frame(market["m15"], bad, day)


def test_sessions_of_a_dataset_agree(spark, market):
    new_york, london = cal.SESSIONS["new_york"], cal.SESSIONS["london"]
    made = {s.code: targets.peak_targets(features.feature_frame(market["m15"], market["h1"], s), market["m1"], s) for s in (new_york, london)}
    assert dataset.build_dataset(made["london"], session=london).data.count() == dataset.build_dataset(made["london"]).data.count() > 0
    for rows, session in ((made["london"], new_york), (made["london"].unionByName(made["new_york"]), None), (made["london"].limit(0), london), (made["london"].limit(0), None)):
        with pytest.raises(ValueError):
            dataset.build_dataset(rows, session=session)
