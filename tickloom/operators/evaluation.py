"""Probability metrics by source and group: Brier, log-loss, ranking, confusion, calibration and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.windows import running_totals
from tickloom.operators.quality import validate_probabilities

SOURCES = ("model_probability", "baseline_probability")
THRESHOLDS = (0.3, 0.4, 0.5, 0.6, 0.7)
CLIP = 2.2e-16
BUCKETS = 1024  # parts of the probability range that are ranked on their own


def long_form(df: DataFrame, sources: Sequence[str] = SOURCES, actual: str = "actual_target", keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., source, p, y) of the probability columns."""
    return df.select(*keep, F.col(actual).cast("int").alias("y"), *[F.col(s).cast("double").alias(s) for s in sources]).unpivot([*keep, "y"], list(sources), "source", "p")


def _confusion(threshold: Column) -> dict[str, Column]:
    guess, y = F.col("p") >= threshold, F.col("y")
    return {"tn": F.count_if(~guess & (y == 0)), "fp": F.count_if(guess & (y == 0)), "fn": F.count_if(~guess & (y == 1)), "tp": F.count_if(guess & (y == 1))}


def _scores() -> dict[str, Column]:
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return {"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn")), "f1": safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}


def ranking_metrics(rows: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Average precision and ROC-AUC by key from rows (by..., p, y); null where there is one class. Equal p rank together."""
    ties = rows.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).withColumns({"_down": -F.col("p"), "_part": -F.floor(F.col("p") * BUCKETS)})
    ranked = running_totals(ties, {"_tp": F.col("pos"), "_all": F.col("n")}, ["_down"], "_part", by)
    neg, fp = F.col("n") - F.col("pos"), F.col("_all") - F.col("_tp")
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").alias("_p"), F.sum(neg).alias("_n"), F.sum(F.col("pos") * F.col("_tp") / F.col("_all")).alias("_ap"),
        F.sum(neg * (F.col("_tp") - F.col("pos") / 2.0)).alias("_area"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(*by, F.when(both, F.col("_ap") / F.col("_p")).alias("average_precision"), F.when(both, F.try_divide("_area", F.col("_p") * F.col("_n"))).alias("roc_auc"))


def metrics(rows: DataFrame, by: Sequence[str] = ("source",), threshold: float = 0.5) -> DataFrame:
    """A row of figures for each key of rows (by..., p, y)."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    p, y = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP)), F.col("y")
    loss = -F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum("y").alias("positives"), F.avg("y").alias("positive_rate"), F.avg("p").alias("mean_probability"), F.avg((F.col("p") - y) ** 2).alias("brier"), F.avg(loss).alias("log_loss"),
        *[c.alias(k) for k, c in _confusion(F.lit(threshold)).items()])
    return base.join(ranking_metrics(rows, by), list(by)).withColumn("threshold", F.lit(threshold)).withColumns(_scores())


def calibration(rows: DataFrame, bins: int = 10, by: Sequence[str] = ("source",)) -> DataFrame:
    if bins < 2:
        raise ValueError("fewer than 2 bins")
    out = rows.groupBy(*by, F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("observations"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed"))
    return out.withColumns({"bin_lower": F.col("bin") / bins, "bin_upper": (F.col("bin") + 1) / bins, "gap": F.abs(F.col("mean_predicted") - F.col("observed"))})


def threshold_analysis(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ("source",)) -> DataFrame:
    """Confusion counts and scores at each threshold; each row is counted once per threshold inside the aggregation."""
    if not all(0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie between 0 and 1")
    cells = [F.struct(F.lit(float(t)).alias("threshold"), *[c.cast("long").alias(k) for k, c in _confusion(F.lit(t)).items()]) for t in thresholds]
    flat = rows.groupBy(*by).agg(F.array(*cells).alias("cells")).select(*by, F.explode("cells").alias("c")).select(*by, "c.*")
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return flat.withColumn("predicted_positive_rate", (F.col("fp") + F.col("tp")) / total).withColumns(_scores())


def join_sources(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Model and baseline predictions of the same observations; ids must match one to one."""
    joined = model.join(baseline, "observation_id")
    counts = [df.agg(F.count("*"), F.countDistinct("observation_id")).first() for df in (model, baseline, joined)]
    if len({n for pair in counts for n in pair}) != 1:
        raise ValueError("predictions do not match one to one")
    return joined


def evaluate(joined: DataFrame, check: bool = True) -> dict[str, DataFrame]:
    """Metrics, calibration, sessions, thresholds and the model's differences from the baseline."""
    if check:
        for s in SOURCES:
            validate_probabilities(joined, s)
    rows, sessions = long_form(joined), long_form(joined, keep=("session_code",))
    found = metrics(rows)
    of = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    delta = found.agg(*[(of(SOURCES[0], c) - of(SOURCES[1], c)).alias(f"delta_{c}") for c in ("brier", "log_loss", "average_precision", "roc_auc")])
    return {"metrics": found, "comparison": delta, "calibration": calibration(rows), "sessions": metrics(sessions, ("session_code", "source")), "thresholds": threshold_analysis(rows)}
