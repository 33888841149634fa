"""The three products: daily dashboard, closed-month report and research pipeline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tickloom.contracts import ExperimentConfig, ModelConfig
from tickloom.functions.calendar import Period, SessionWindow
from tickloom.operators import baselines, dataset, evaluation, features, intraday, models, monthly, targets, validation


def daily_dashboard(h1: DataFrame, m15: DataFrame, m1: DataFrame, ticks: DataFrame, session: SessionWindow) -> dict[str, DataFrame]:
    priced, signed = intraday.vwap(m1), intraday.signed_ticks(ticks)
    return {
        "vwap": priced, "cvd": intraday.align_cvd(signed, m1), "directions": intraday.direction_matrix(h1, m15, m1), "clusters": intraday.volume_clusters(signed, session),
        "opening_ranges": intraday.opening_ranges(priced, session), "sweeps": intraday.sweeps(m1, signed, session)}


def monthly_report(m1: DataFrame, period: Period) -> dict[str, DataFrame]:
    return {"bars": monthly.anchored(m1), "profile": monthly.volume_profile(m1), "days": monthly.daily_bars(m1), "levels": monthly.macro_levels(m1), "sweeps": monthly.last_sweeps(m1), "coverage": monthly.coverage(m1, period)}


def research_dataset(m15: DataFrame, h1: DataFrame, path: DataFrame, session: SessionWindow, config: ExperimentConfig = ExperimentConfig()) -> dataset.ResearchDataset:
    observed = features.feature_frame(m15, h1, session, config)
    return dataset.build_dataset(targets.peak_targets(observed, path, session, config), config, session=session)


@dataclass(frozen=True)
class Experiment:
    model: models.TrainedModel
    predictions: DataFrame
    evaluation: dict[str, DataFrame]


def experiment(splits: DataFrame, names: tuple[str, ...], config: ModelConfig = ModelConfig()) -> Experiment:
    """Train on one fold's kept rows and evaluate model and baseline on its test rows; parts that are empty or overlap are an error."""
    validation.check_splits(splits if "fold" in splits.columns else splits.withColumn("fold", F.lit(0)))
    kept = splits.where("kept")
    part = {p: kept.where(kept.part == p) for p in validation.PARTS}
    trained = models.train(part["train"], part["validation"], names, config)
    predicted = models.predict(trained, part["test"])
    constant = baselines.constant_predictions(part["train"], part["test"], config.target)
    joined = evaluation.join_sources(predicted, constant)
    return Experiment(trained, joined, evaluation.evaluate(joined))
