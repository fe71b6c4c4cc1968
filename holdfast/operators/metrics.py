"""Prediction metrics, reliability bins and the calibration gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.config import SETTINGS, Settings
from holdfast.functions.numbers import ratio
from holdfast.functions.ordering import positions, tile, value_ranks

CLIP = 1e-9


class CalibrationGateError(RuntimeError):
    pass


def reliability_table(scored: DataFrame, group: Sequence[str], tie: Sequence[str],
                      bins: int = SETTINGS.reliability_bins) -> DataFrame:
    """Equal-count bins of `p`: mean prediction, observed rate and rows per bin."""
    placed = positions(scored, group, "p", tie)
    return placed.groupBy(*group, tile(F.col("position"), F.col("n_rows"), bins).alias("bin")).agg(
        F.avg("p").alias("bin_mean_predicted"),
        F.avg(F.col("y").cast("double")).alias("bin_observed_rate"),
        F.count(F.lit(1)).alias("bin_count"))


def calibration_error(bins: DataFrame, group: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("bin_mean_predicted") - F.col("bin_observed_rate"))
    return bins.groupBy(*group).agg(ratio(
        F.sum(F.col("bin_count") * gap), F.sum("bin_count")).alias("ece"))


def roc_auc(scored: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rank-sum AUC with average ranks; null when one class is missing."""
    y = F.col("y").cast("long")
    ranks = value_ranks(scored, group, "p", sums={"pos": y})
    total = ranks.groupBy(*group).agg(
        F.sum(F.col("mid_rank") * F.col("pos")).alias("s"),
        F.sum("pos").cast("double").alias("n1"), F.sum("n").cast("double").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return total.select(*group, ((F.col("s") - n1 * (n1 + 1) / 2) / F.nullif(
        n1 * n0, F.lit(0.0))).alias("roc_auc"))


def _log_loss() -> Column:
    p = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.avg(-F.when(F.col("y"), F.log(p)).otherwise(F.log(1 - p)))


def with_all_group(scored: DataFrame, column: str = "archetype") -> DataFrame:
    """Every row once under its own group and once under `all`."""
    return scored.withColumn(column, F.explode(F.array(F.lit("all"), F.col(column))))


def prediction_metrics(scored: DataFrame, group: Sequence[str], tie: Sequence[str],
                       bins: int = SETTINGS.reliability_bins) -> DataFrame:
    """Rows, base rate, Brier and its skill, log loss, AUC and calibration error per group.

    `scored` has a probability `p` and a boolean outcome `y`.
    """
    y = F.col("y").cast("double")
    basic = scored.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(y).alias("positive_rate"),
        F.avg("p").alias("mean_predicted"), F.avg((F.col("p") - y) * (F.col("p") - y))
        .alias("brier"), _log_loss().alias("log_loss"))
    base = F.col("positive_rate") * (1 - F.col("positive_rate"))
    basic = basic.withColumn("brier_skill_vs_base_rate", F.when(
        base > 0, 1 - F.col("brier") / base).otherwise(F.lit(0.0)))
    ece = calibration_error(reliability_table(scored, group, tie, bins), group)
    return basic.join(roc_auc(scored, group), list(group)).join(ece, list(group))


def calibration_failures(metrics: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    return metrics.where((F.col("split") == "test") & (F.col("archetype") == "all")
                         & (F.col("ece") > settings.max_ece))


def require_calibrated(metrics: DataFrame, settings: Settings = SETTINGS) -> None:
    bad = calibration_failures(metrics, settings).select("family", "ece").collect()
    if bad:
        raise CalibrationGateError("; ".join(
            f"{r.family}: test ECE {r.ece:.4f} > {settings.max_ece}" for r in bad))
