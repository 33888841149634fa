"""Registered queries: one per operator, over the generic tables, each with the same result in plain SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.contracts import ExperimentConfig, ModelConfig, MonthKey
from tickloom.functions import calendar as cal
from tickloom.functions.stored import shared_folder, stored
from tickloom.operators import baselines, dataset, evaluation, features, intraday, models, monthly, quality, targets, validation
from tickloom.plans import products, sql as S
from tickloom.sources import events as ev, lake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NEW_YORK, OVERNIGHT = cal.SESSIONS["new_york"], cal.SessionWindow("overnight", 22 * 60, 2 * 60)
FULL_DAY = cal.SESSIONS["full_day"]
#: The events cover a quarter of the minutes, so paths are made of 15-minute bars here.
CONFIG = ExperimentConfig(path_minutes=15)
JANUARY = cal.Period(dt.date(2024, 1, 1), dt.date(2024, 2, 1))


def query(sql: str | None = None, digits: int = 6):
    """Register a query; doubles are rounded on both sides and small integers widened."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            kinds = dict(df.dtypes)
            return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" else F.col(c).cast("int").alias(c) if kinds[c] in ("tinyint", "smallint") else F.col(c) for c in df.columns])

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = S.rounded(sql, digits)
        return f

    return register


def _bars(spark: SparkSession, sf_dir: str, minutes: int) -> DataFrame:
    return ev.bars(ev.table(spark, sf_dir, "events"), minutes)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intraday.signed_ticks(ev.ticks(ev.table(spark, sf_dir, "events")))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.observations(ev.table(spark, sf_dir, "orders"))


# ---- sources, calendar, quality ----
@query(S.BARS_M15)
def bars_m15(spark, d):
    return _bars(spark, d, 15)


@query(S.BARS_H1)
def bars_h1(spark, d):
    return _bars(spark, d, 60)


@query(S.SCAN_DAY)
def scan_day_range(spark, d):
    lo, hi = cal.day_range_utc(dt.date(2024, 1, 10), dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc))
    rows = cal.between_utc(ev.table(spark, d, "events"), lo, hi, "ts")
    return rows.select("event_id", "ts", cal.local_time("ts").alias("timestamp_cot"), "value")


@query(S.WEEKDAYS)
def weekday_filter(spark, d):
    return cal.weekdays_only(_bars(spark, d, 15)).select("timestamp_utc", "timestamp_cot", "close")


@query(S.SESSION_NEW_YORK)
def session_filter_new_york(spark, d):
    return cal.filter_session(_bars(spark, d, 15), NEW_YORK).select("timestamp_cot", "session_code", "session_date", "minute_of_session", "session_progress")


@query(S.SESSION_OVERNIGHT)
def session_filter_overnight(spark, d):
    return cal.filter_session(_bars(spark, d, 15), OVERNIGHT).select("timestamp_cot", "session_code", "session_date", "minute_of_session", "session_progress")


@query(S.SESSION_COLUMNS)
def session_columns(spark, d):
    return cal.filter_observations(features.add_availability(_bars(spark, d, 15)), FULL_DAY).select("timestamp_cot", "observation_time_cot", "session_date", "minute_of_session", "session_progress")


@query(S.PERIOD_MONTHS)
def period_months(spark, d):
    lo, hi = cal.closed_months(dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2026, 1, 1)).bounds_utc
    return cal.between_utc(_bars(spark, d, 60), lo, hi).groupBy(F.to_date("timestamp_cot").alias("date")).agg(F.count("*").alias("bars"))


@query(S.TIME_FEATURES)
def time_features(spark, d):
    return cal.add_time_features(_bars(spark, d, 15)).select("timestamp_utc", "minute_of_day", "iso_weekday", "time_sin", "time_cos", "day_of_year", "month")


@query(S.ZONES)
def zone_table(spark, d):
    return cal.zone_table(_bars(spark, d, 60)).withColumn("offset_hours", F.col("offset_hours").cast("double"))


@query(S.DEDUP)
def dedup_bars(spark, d):
    b = _bars(spark, d, 60)
    return quality.reconcile_duplicates(b.unionByName(b.where(F.hour("timestamp_utc") < 6))).select("timestamp_utc", "open", "close", "volume")


@query(S.QUALITY)
def bar_quality(spark, d):
    b = _bars(spark, d, 15)
    broken = b.withColumn("high", F.when(F.minute("timestamp_utc") == 15, F.col("open") - 1).otherwise(F.col("high"))).withColumn("low", F.when(F.minute("timestamp_utc") == 30, F.lit(None)).otherwise(F.col("low")))
    return quality.bar_violations(broken)


# ---- intraday ----
@query(S.VWAP, 4)
def vwap_sigma(spark, d):
    return intraday.vwap(_bars(spark, d, 15)).select("timestamp_utc", "vwap", "sigma")


@query(S.SIGNED, 4)
def signed_ticks_cvd(spark, d):
    return _signed(spark, d).select("seq", "price", "weight", "side", "delta", "cvd")


@query(S.ASOF_CVD, 4)
def asof_cvd(spark, d):
    return intraday.align_cvd(_signed(spark, d), _bars(spark, d, 15)).select("timestamp_utc", "cvd")


@query(S.DIRECTIONS)
def direction_matrix(spark, d):
    return intraday.direction_matrix(_bars(spark, d, 60), _bars(spark, d, 15), _bars(spark, d, 1)).select("timestamp_utc", "m1", "m15", "h1")


@query(S.CLUSTERS, 4)
def volume_clusters(spark, d):
    return intraday.volume_clusters(_signed(spark, d), NEW_YORK).drop("symbol")


@query(S.DELTA_MINUTES, 4)
def delta_by_minute(spark, d):
    return intraday.delta_by_minute(_signed(spark, d)).drop("symbol")


@query(S.OPENING, 4)
def opening_range(spark, d):
    return intraday.opening_ranges(intraday.vwap(_bars(spark, d, 1)), NEW_YORK).drop("symbol")


@query(S.SWEEPS, 4)
def liquidity_sweeps(spark, d):
    return intraday.sweeps(_bars(spark, d, 1), _signed(spark, d), NEW_YORK).drop("symbol")


# ---- monthly ----
@query(S.ANCHORED, 4)
def monthly_avwap_cvd(spark, d):
    return monthly.anchored(_bars(spark, d, 15)).select("timestamp_utc", "avwap", "cvd_proxy")


@query(S.PROFILE)
def volume_profile_poc(spark, d):
    return monthly.volume_profile(_bars(spark, d, 15)).drop("symbol")


@query(S.DAILY)
def daily_ohlc_atr(spark, d):
    return monthly.daily_bars(_bars(spark, d, 15)).drop("symbol")


@query(S.LEVELS, 4)
def macro_levels(spark, d):
    return monthly.macro_levels(_bars(spark, d, 15)).drop("symbol")


@query(S.DAILY_SWEEPS)
def daily_sweeps(spark, d):
    return monthly.daily_sweeps(_bars(spark, d, 15)).drop("symbol")


@query(S.COVERAGE)
def coverage(spark, d):
    return monthly.coverage(_bars(spark, d, 15), JANUARY).drop("symbol")


def _sizes(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


# ---- products and the lake ----
@query(S.DASHBOARD)
def daily_dashboard(spark, d):
    made = products.daily_dashboard(_bars(spark, d, 60), _bars(spark, d, 15), _bars(spark, d, 1), ev.ticks(ev.table(spark, d, "events")), NEW_YORK)
    return _sizes(made)


@query(S.MONTH_REPORT)
def monthly_report(spark, d):
    made = products.monthly_report(_bars(spark, d, 15), JANUARY)
    return _sizes({k: df for k, df in made.items() if k != "sweeps"})


@query(S.LAST_SWEEPS)
def last_sweeps(spark, d):
    return products.monthly_report(_bars(spark, d, 15), JANUARY)["sweeps"].drop("symbol")


def _lake(spark, d) -> str:
    """The hours of the events as a lake in a shared folder."""
    root = shared_folder(spark)
    lake.write_lake(_bars(spark, d, 60), root, "h1", ev.SYMBOL)
    return root


@query(S.LAKE_AUDIT)
def lake_audit(spark, d):
    return lake.audit_counters(spark, _lake(spark, d), "h1", ev.SYMBOL)


@query(S.LAKE_CONTEXT)
def lake_context(spark, d):
    found = lake.load_context(spark, _lake(spark, d), ev.SYMBOL, JANUARY, ("h1",))
    return lake.summarise(found).drop("memory_bytes")


@query(S.LAKE_FILES)
def lake_files(spark, d):
    """Days, rows and range of a period, as file names and footers tell them."""
    files = lake.stored_files(spark, _lake(spark, d), "h1", ev.SYMBOL, cal.Period(dt.date(2024, 1, 5), dt.date(2024, 1, 20)))
    day = F.regexp_extract("file", r"day=(\d+)", 1).cast("int").alias("day")
    return files.groupBy(day).agg(F.sum("rows").alias("rows"), F.min("first_utc").alias("first_utc"), F.max("last_utc").alias("last_utc"))


# ---- features ----
def _measured(spark, d):
    return features.add_atr(features.add_geometry(features.add_availability(_bars(spark, d, 15))), 14)


@query(S.GEOMETRY)
def candle_geometry(spark, d):
    return features.add_geometry(_bars(spark, d, 15)).select("timestamp_utc", "body", "body_abs", "bar_range", "upper_wick", "lower_wick", "body_to_range", "close_location", "candle_direction")


@query(S.RETURNS)
def returns_vol(spark, d):
    return features.add_returns(_bars(spark, d, 15)).select("timestamp_utc", "return_15m", "return_30m", "return_60m", "realized_vol_60m", "realized_vol_4h", "direction_balance_60m")


@query(S.ATR)
def atr(spark, d):
    return _measured(spark, d).select("timestamp_utc", "true_range", "atr", "range_atr", "body_atr")


@query(S.VOLUME)
def volume_features(spark, d):
    return features.add_volume(_bars(spark, d, 15)).select("timestamp_utc", "volume_sum_short", "volume_mean_prior", "volume_std_prior", "volume_ratio", "volume_zscore", "real_to_tick_volume")


@query(S.DAILY_VWAP)
def daily_vwap(spark, d):
    return features.add_daily_vwap(_measured(spark, d)).select("timestamp_utc", "calendar_date", "daily_vwap", "distance_daily_vwap", "distance_daily_vwap_atr", "daily_vwap_slope")


@query(S.EXTREMES)
def prior_extremes(spark, d):
    return features.add_prior_extremes(_measured(spark, d)).select("timestamp_utc", "prior_high", "prior_low", "distance_prior_high_atr", "distance_prior_low_atr", "sweep_prior_high", "sweep_prior_low")


@query(S.H1_CONTEXT)
def h1_context_asof(spark, d):
    joined = features.join_context(features.add_availability(_bars(spark, d, 15)), features.context_features(_bars(spark, d, 60)))
    return joined.select("timestamp_utc", "h1_available_at_utc", "h1_body", "h1_direction", "h1_return_1")


@query(S.SESSION_VWAP)
def session_vwap(spark, d):
    df = _measured(spark, d).withColumn("typical_price", intraday.typical_price())
    return features.add_session_vwap(cal.filter_observations(df, NEW_YORK)).select("timestamp_utc", "session_date", "session_vwap", "distance_session_vwap", "distance_session_vwap_atr", "session_vwap_slope")


def _features(spark, d, session=NEW_YORK):  # of the smallest tables no row may be left, so later steps do not ask for rows
    return features.feature_frame(_bars(spark, d, 15), _bars(spark, d, 60), session, CONFIG, check=False)  # grouped by time, so no time comes twice


@query(S.FEATURE_FRAME)
def feature_frame(spark, d):
    return _features(spark, d).select("timestamp_utc", "session_date", *features.MODEL_FEATURES)


# ---- targets and datasets ----
def _targets(spark, d, session=NEW_YORK, drop=False, config=CONFIG):
    return targets.peak_targets(_features(spark, d, session), _bars(spark, d, 15), session, config, drop, check=False)


@query(S.TARGET_CONTRACT)
def target_contract_counters(spark, d):
    """Observations of two sessions, those of one of them twice, against the contract of the other."""
    columns = [*targets.KEY, "session_date", "close", "atr"]
    own, other = (_features(spark, d, s).select(*columns) for s in (NEW_YORK, cal.SESSIONS["london"]))
    return targets.observation_violations(own.unionByName(other).unionByName(other), NEW_YORK)


@query(S.EXCURSIONS)
def targets_excursions(spark, d):
    return _targets(spark, d).select("observation_time_utc", "future_high", "future_low", "mfe_points", "mae_points", "adverse_before_peak_points", "mfe_atr", "mae_atr", "adverse_before_peak_atr", "time_to_peak_minutes", "time_to_trough_minutes", "peak_timestamp_utc", "trough_timestamp_utc")


@query(S.THRESHOLDS)
def targets_thresholds(spark, d):
    return _targets(spark, d, drop=True).select("observation_time_utc", *CONFIG.thresholds.columns)


@query(S.BARRIER)
def triple_barrier(spark, d):
    return _targets(spark, d).select("observation_time_utc", "triple_barrier_label", "first_barrier_touch_minutes", "target_ambiguous", "target_valid")


@query(S.FILLED)
def filled_minutes(spark, d):
    return intraday.fill_minutes(_bars(spark, d, 1)).drop("symbol", "spread", "real_volume")


@query(S.M1_PATHS)
def targets_m1_paths(spark, d):
    """Paths of 60 one-minute bars, of which those without events are flat."""
    made = targets.peak_targets(_features(spark, d), intraday.fill_minutes(_bars(spark, d, 1)), NEW_YORK, ExperimentConfig(), False, check=False)
    return made.select("observation_time_utc", "future_high", "future_low", "mfe_atr", "mae_atr", "adverse_before_peak_atr", "time_to_peak_minutes", "time_to_trough_minutes", "first_barrier_touch_minutes", "triple_barrier_label", "target_exclusion_reason")


@query(S.EXCLUSIONS)
def target_exclusions(spark, d):
    return targets.exclusion_report(_targets(spark, d))


@query(S.DATASET_IDS)
def dataset_ids(spark, d):
    made = dataset.build_dataset(_targets(spark, d), CONFIG, check=False)
    return made.data.select("observation_id", "session_code", "session_date", "target_peak_075_atr", "dataset_version")


@query(S.COMBINED)
def combine_sessions(spark, d):
    parts = [dataset.build_dataset(_targets(spark, d, cal.SESSIONS[s]), CONFIG, check=False) for s in ("new_york", "london")]
    return dataset.combine(*parts).data.groupBy("session_code").agg(F.count("*").alias("rows"), F.sum("target_peak_050_atr").alias("positives"))


# ---- baselines ----
def _research(spark, d):
    return _targets(spark, d, FULL_DAY, True)


@query(S.BASE_GLOBAL)
def baseline_global(spark, d):
    return baselines.global_rates(_research(spark, d))


@query(S.BASE_SESSION)
def baseline_by_session(spark, d):
    return baselines.by_session(_research(spark, d))


@query(S.BASE_MINUTE)
def baseline_by_minute(spark, d):
    return baselines.by_session_minute(_research(spark, d), least=5)


@query(S.BASE_WEEKDAY)
def baseline_by_weekday(spark, d):
    return baselines.by_weekday(_research(spark, d))


@query(S.TERCILES)
def atr_terciles(spark, d):
    return baselines.atr_terciles(_research(spark, d))


@query(S.BASE_REGIME)
def baseline_by_regime(spark, d):
    return baselines.by_regime(_research(spark, d))


@query(S.BASE_REPORT)
def baseline_report(spark, d):
    return _sizes(baselines.report(stored(_research(spark, d))))


@query(S.CONSTANT)
def constant_predictions_grouped(spark, d):
    obs = _observations(spark, d)
    train, later = obs.where("session_date < DATE'1999-01-01'"), obs.where("session_date >= DATE'1999-01-01'")
    return baselines.constant_predictions(train, later, groups=("session_code", "minute_of_session"), least=12)


@query(S.CONSTANT_GLOBAL)
def constant_predictions_global(spark, d):
    obs = _observations(spark, d)
    return baselines.constant_predictions(obs.where("session_date < DATE'1999-01-01'"), obs.where("session_date >= DATE'1999-01-01'"))


# ---- validation ----
@query(S.MONTHS)
def available_months(spark, d):
    return validation.available_months(_observations(spark, d))


def _folds(spark, d, expanding=True):
    months = [MonthKey(r.year, r.month) for r in validation.available_months(_observations(spark, d)).collect()]
    return validation.walk_forward_folds(months, expanding=expanding)


@query(S.FOLDS)
def walk_forward_folds(spark, d):
    return validation.fold_table(spark, _folds(spark, d))


@query(S.FOLDS_ROLLING)
def walk_forward_folds_rolling(spark, d):
    return validation.fold_table(spark, _folds(spark, d, False))


@query(S.PURGED)
def purged_split(spark, d):
    folds = _folds(spark, d)
    return validation.fold_summary(validation.assign_folds(_observations(spark, d), folds), folds)


@query(S.SINGLE_MONTH)
def single_month_split(spark, d):
    return validation.split_summary(validation.single_month_split(_research(spark, d)))


# ---- evaluation and models ----
def _predictions(spark, d):
    return _observations(spark, d).withColumn("actual_target", F.col("target_peak_075_atr"))


@query(S.METRICS)
def probability_metrics(spark, d):
    return evaluation.metrics(evaluation.long_form(_predictions(spark, d))).drop("average_precision", "roc_auc", "threshold")


@query(S.RANKING)
def average_precision_auc(spark, d):
    return evaluation.ranking_metrics(evaluation.long_form(_predictions(spark, d)))


@query(S.CALIBRATION)
def calibration(spark, d):
    return evaluation.calibration(evaluation.long_form(_predictions(spark, d)))


@query(S.THRESHOLD_ANALYSIS)
def threshold_analysis(spark, d):
    return evaluation.threshold_analysis(evaluation.long_form(_predictions(spark, d)))


@query(S.SESSION_EVALUATION)
def session_evaluation(spark, d):
    rows = evaluation.long_form(_predictions(spark, d), keep=("session_code",))
    return evaluation.metrics(rows, ("session_code", "source")).select("session_code", "source", "rows", "positives", "brier", "tn", "fp", "fn", "tp", "precision", "recall", "f1", "roc_auc", "average_precision")


@query(S.COMPARISON)
def model_vs_baseline(spark, d):
    p = _predictions(spark, d)
    joined = evaluation.join_sources(p.select("observation_id", "session_code", "actual_target", "model_probability"), p.select("observation_id", "baseline_probability"))
    return evaluation.evaluate(joined, check=False)["comparison"]


#: A model given by its numbers: features, means, scales, weights, intercept.
GIVEN = models.TrainedModel(("f_minute", "f_session", "f_month"), (80.0, 3.0, 6.5), (50.0, 1.4, 3.4), (0.35, -0.8, 0.05), -0.4, 1.0, (), ModelConfig())


@query(S.GIVEN_MODEL)
def logistic_probabilities(spark, d):
    rows = _observations(spark, d).withColumns(_inputs())
    return models.predict(GIVEN, rows).select("observation_id", "session_code", "model_probability", "model_target", "model_c", "actual_target")


def _inputs() -> dict:
    return {"f_minute": F.col("minute_of_session").cast("double"), "f_session": F.col("session_code").cast("double"), "f_month": F.month("session_date").cast("double")}


@query()
def logistic_predictions(spark, d):
    """The test rows of every walk-forward fold, each predicted by the model of its fold."""
    obs = _observations(spark, d).withColumns(_inputs())
    names, folds = ("f_minute", "f_session", "f_month"), _folds(spark, d)
    obs = obs.select("observation_id", "observation_time_utc", "session_code", "session_date", "target_horizon_end_utc", ModelConfig().target, *names)
    assigned = validation.assign_folds(obs, folds)
    trained = models.train_folds(assigned, names)
    return models.predict_folds(trained, validation.part_rows(assigned, "test")).select("fold", "observation_id", "model_probability", "model_target", "model_c", "actual_target")
