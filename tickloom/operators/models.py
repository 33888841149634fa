"""Regularised logistic models: standardised on training rows, C chosen on validation rows by Brier score.

All folds and all C values are fitted together by Newton's method. Rows are stored once, with the ranges of folds that they
train or validate (`validation.assign_folds`); a pass visits each row once and gives, for each fold, the losses, gradients
and curvatures of its candidates as sums of partitions. Means and deviations of a fold are put together from those of the
ranges that occur. What reaches the driver has the size of folds times C values times squared features, whatever the
number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.contracts import ModelConfig
from tickloom.functions.stored import stored
from tickloom.operators.quality import require_columns
from tickloom.operators.validation import part_rows

CLIP = 2.2e-16
TOLERANCE = 1e-10  # of the Newton decrement


@dataclass(frozen=True)
class TrainedModel:
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    coefficients: tuple[float, ...]  # of the standardised features
    intercept: float
    c: float
    candidates: tuple[tuple[float, float, float], ...]  # C, Brier, log-loss
    config: ModelConfig


@dataclass
class _Fit:
    means: np.ndarray
    scales: np.ndarray
    class_weights: tuple[float, float]
    at: np.ndarray  # a row of coefficients and intercept for each C
    step: np.ndarray
    best: np.ndarray  # objective at the last accepted point
    done: np.ndarray


RANGES = ("train_first", "train_last", "validation_first", "validation_last")


def _start(rows: DataFrame, features: Sequence[str], config: ModelConfig) -> dict[int, _Fit]:
    """Means and population deviations of each fold's training rows; ValueError for unusable rows."""
    target = F.col(config.target)
    sound = F.lit(True)
    for f in features:
        sound = sound & F.coalesce(F.abs(F.col(f)) < float("inf"), F.lit(False)) & ~F.isnan(f)
    binary = F.coalesce(target.isin(0, 1), F.lit(False))
    stats = rows.groupBy(*RANGES).agg(
        F.count("*").alias("n"), F.count_if(~sound).alias("unsound"), F.count_if(~binary).alias("unknown"), F.count_if(target == 1).alias("positive"),
        F.array(*[F.avg(f) for f in features]).alias("means"), F.array(*[F.var_pop(f) for f in features]).alias("variances")).collect()  # a row for each range of folds
    if not stats:
        raise ValueError("no rows to learn from")
    holds = lambda s, part, f: s[f"{part}_first"] is not None and s[f"{part}_first"] <= f <= s[f"{part}_last"]
    firsts = [s[f"{p}_first"] for s in stats for p in ("train", "validation") if s[f"{p}_first"] is not None]
    lasts = [s[f"{p}_last"] for s in stats for p in ("train", "validation") if s[f"{p}_last"] is not None]
    out = {}
    for f in range(min(firsts), max(lasts) + 1):
        of = {part: [s for s in stats if holds(s, part, f)] for part in ("train", "validation")}
        unsound, unknown = (sum(s[k] for part in of.values() for s in part) for k in ("unsound", "unknown"))
        if unsound or unknown:
            raise ValueError(f"fold {f}: {unsound} rows with a null or infinite feature, {unknown} without a binary target")
        rate = {}
        for part, some in of.items():
            n, positive = sum(s.n for s in some), sum(s.positive for s in some)
            if not 0 < positive < n:
                raise ValueError(f"fold {f}: {config.target} needs both classes in {part}")
            rate[part] = positive / n
        n, own = np.array([s.n for s in of["train"]], float)[:, None], np.array([s.means for s in of["train"]])
        means = (n * own).sum(axis=0) / n.sum()
        variance = (n * (np.array([s.variances for s in of["train"]]) + (own - means) ** 2)).sum(axis=0) / n.sum()
        shape = (len(config.c_values), len(features) + 1)
        weights = (0.5 / (1 - rate["train"]), 0.5 / rate["train"]) if config.balanced else (1.0, 1.0)
        out[f] = _Fit(means, np.where(variance > 0, np.sqrt(variance), 1.0), weights, np.zeros(shape), np.zeros(shape), np.full(shape[0], np.inf), np.zeros(shape[0], bool))
    return out


def _sums(rows: DataFrame, features: Sequence[str], target: str, fits: Mapping[int, _Fit]) -> dict[int, np.ndarray]:
    """For each fold: losses, gradients and curvatures of its candidates, unpenalised, in one vector."""
    names, state = list(features), {f: (fit.means, fit.scales, fit.class_weights, fit.at) for f, fit in fits.items()}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            first, last = batch["train_first"].to_numpy(), batch["train_last"].to_numpy()
            raw, label = batch[names].to_numpy(float), batch[target].to_numpy(float)[:, None]
            for fold, (means, scales, class_weights, points) in state.items():
                at = (first <= fold) & (fold <= last)
                if not at.any():
                    continue
                x, y = np.column_stack([(raw[at] - means) / scales, np.ones(int(at.sum()))]), label[at]
                weight = np.where(y == 1, class_weights[1], class_weights[0])
                margin = x @ points.T
                p = 0.5 * (1 + np.tanh(margin / 2))
                loss = (weight * (np.logaddexp(0, margin) - y * margin)).sum(axis=0)
                gradient = (weight * (p - y)).T @ x
                curvature = [x.T @ (x * h[:, None]) for h in (weight * p * (1 - p)).T]
                found = np.concatenate([loss, gradient.ravel(), np.ravel(curvature)])
                total[fold] = total[fold] + found if fold in total else found
        if total:
            yield pd.DataFrame({"fold": list(total), "sums": [v.tolist() for v in total.values()]})

    parts = rows.mapInPandas(partial, "fold int, sums array<double>").withColumn("sums", array_to_vector("sums"))
    return {r.fold: r.sums.toArray() for r in parts.groupBy("fold").agg(Summarizer.sum(F.col("sums")).alias("sums")).collect()}


def _advance(fit: _Fit, sums: np.ndarray, c_values: Sequence[float]) -> None:
    """Accept the point or halve the step to it, then take the next Newton step of each candidate that is not done."""
    n, k = fit.at.shape
    loss, gradient, curvature = sums[:n], sums[n : n + n * k].reshape(n, k), sums[n + n * k :].reshape(n, k, k)
    for i, c in enumerate(c_values):
        if fit.done[i]:
            continue
        w = fit.at[i].copy()
        value = 0.5 * w @ w + c * loss[i]
        if value > fit.best[i] * (1 + 1e-12):
            fit.step[i] /= 2
            fit.at[i] -= fit.step[i]
            continue
        fit.best[i] = value
        slope = w + c * gradient[i]
        move = -np.linalg.solve(np.eye(k) + c * curvature[i], slope)
        fit.done[i] = -slope @ move <= TOLERANCE * max(1.0, value)
        if not fit.done[i]:
            fit.step[i] = move
            fit.at[i] = w + move


def _table(spark, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "fold int, _m array<double>, _s array<double>, _w array<double>, _b double, model_c double")


def _probability(features: Sequence[str]) -> Column:
    margin = F.col("_b")
    for i, f in enumerate(features):
        margin = margin + F.col("_w")[i] * (F.col(f).cast("double") - F.col("_m")[i]) / F.col("_s")[i]
    return 1 / (1 + F.exp(-margin))


def _ranged(splits: DataFrame) -> DataFrame:
    """Rows with the ranges of folds that they are in; those of `validation.temporal_splits` are in one each."""
    if "fold" not in splits.columns:
        return splits
    only = lambda part: F.when(F.col("kept") & (F.col("part") == part), F.col("fold"))
    return splits.withColumns({f"{part}_{side}": only(part) for part in ("train", "validation") for side in ("first", "last")})


def train_folds(splits: DataFrame, features: Sequence[str], config: ModelConfig = ModelConfig()) -> dict[int, TrainedModel]:
    """A model for each fold of rows of `validation.assign_folds`, or of rows with fold, part and kept.

    Minimises w.w / 2 + C * (sum of weighted losses), with the intercept among w. Null or infinite features, targets that
    are not binary and parts with one class are a ValueError.
    """
    require_columns(splits, [*features, config.target, *(("fold", "part", "kept") if "fold" in splits.columns else RANGES)], "the split frame")
    own = [F.col(config.target).cast("int").alias(config.target), *[F.col(f).cast("double").alias(f) for f in features]]
    rows = stored(_ranged(splits).where("train_first IS NOT NULL OR validation_first IS NOT NULL").select(*RANGES, *own))
    fits = _start(rows, features, config)
    training = rows.where("train_first IS NOT NULL").drop("validation_first", "validation_last")
    for _ in range(config.max_iter):
        going = {f: fit for f, fit in fits.items() if not fit.done.all()}
        if not going:
            break
        for f, sums in _sums(training, features, config.target, going).items():
            _advance(fits[f], sums, config.c_values)
    models = [(f, fit.means.tolist(), fit.scales.tolist(), w[:-1].tolist(), float(w[-1]), c) for f, fit in fits.items() for w, c in zip(fit.at, config.c_values)]
    table = _table(splits.sparkSession, models)  # folds times C values
    actual = F.col(config.target).cast("double")
    scored = part_rows(rows, "validation").join(F.broadcast(table), "fold").withColumn("_p", _probability(features))
    clipped = F.least(F.greatest("_p", F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -(actual * F.log(clipped) + (1 - actual) * F.log(1 - clipped))
    found = {(r.fold, r.model_c): (r.brier, r.loss) for r in scored.groupBy("fold", "model_c").agg(F.avg((F.col("_p") - actual) ** 2).alias("brier"), F.avg(loss).alias("loss")).collect()}
    out = {}
    for f, fit in fits.items():
        c = min(config.c_values, key=lambda c: (*found[f, c], c))
        w = fit.at[config.c_values.index(c)]
        out[f] = TrainedModel(tuple(features), tuple(fit.means.tolist()), tuple(fit.scales.tolist()), tuple(w[:-1].tolist()), float(w[-1]), c, tuple((c, *found[f, c]) for c in config.c_values), config)
    return out


def train(train_rows: DataFrame, validation_rows: DataFrame, features: Sequence[str], config: ModelConfig = ModelConfig()) -> TrainedModel:
    own = [config.target, *features]
    require_columns(train_rows, own, "the training frame")
    require_columns(validation_rows, own, "the validation frame")
    part = lambda df, name: df.select(*own, F.lit(0).alias("fold"), F.lit(name).alias("part"), F.lit(True).alias("kept"))
    return train_folds(part(train_rows, "train").unionByName(part(validation_rows, "validation")), features, config)[0]


def predict(trained: TrainedModel, df: DataFrame) -> DataFrame:
    """observation_id, the identifiers present, model_probability, model_target, model_c and actual_target."""
    return predict_folds({0: trained}, df.withColumn("fold", F.lit(0))).drop("fold")


def predict_folds(trained: Mapping[int, TrainedModel], df: DataFrame) -> DataFrame:
    """Like `predict`, for rows with a fold, each by the model of its fold; all models have the same features and target."""
    one = next(iter(trained.values()))
    table = _table(df.sparkSession, [(f, list(t.means), list(t.scales), list(t.coefficients), t.intercept, t.c) for f, t in trained.items()])
    own = [c for c in ("observation_id", "observation_time_utc", "session_code", "session_date") if c in df.columns]
    return df.join(F.broadcast(table), "fold").select("fold", *own, _probability(one.features).alias("model_probability"), F.lit(one.config.target).alias("model_target"), "model_c", F.col(one.config.target).alias("actual_target"))


def coefficient_table(spark, trained: TrainedModel) -> DataFrame:
    rows = [(f, float(c), abs(float(c))) for f, c in zip(trained.features, trained.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double, magnitude double").orderBy(F.desc("magnitude"), "feature")


def candidate_table(spark, trained: TrainedModel) -> DataFrame:
    return spark.createDataFrame([(c, b, lo, c == trained.c) for c, b, lo in trained.candidates], "c double, brier double, log_loss double, selected boolean").orderBy("brier", "log_loss", "c")
