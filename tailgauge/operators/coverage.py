"""Coverage tests of violation sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ALPHA, binomial_loglik, chi_square_tail, x_log_p
from .metrics import GROUP, hit, summary_columns


def kupiec_ratio(n: Column, x: Column, alpha: float = ALPHA) -> Column:
    """Likelihood ratio of the observed against the nominal violation rate."""
    fitted = binomial_loglik(x, n, x / n)
    return F.greatest(F.lit(0.0), F.lit(2.0) * (fitted - binomial_loglik(x, n, F.lit(alpha))))


def kupiec_uc(predictions: DataFrame, group: Sequence[str] = GROUP, alpha: float = ALPHA,
              significance: float = 0.05) -> DataFrame:
    """Unconditional coverage: one aggregate to (n, x), the rest on one row per group."""
    counts = predictions.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_if(hit()).alias("n_violations")
    )
    return with_kupiec(counts, alpha, significance)


def with_kupiec(counts: DataFrame, alpha: float = ALPHA, significance: float = 0.05) -> DataFrame:
    n, x = F.col("n_targets"), F.col("n_violations")
    return (
        counts.withColumn("violation_rate", x / n)
        .withColumn("expected_violations", n * F.lit(alpha))
        .withColumn("expected_nonviolations", n * F.lit(1.0 - alpha))
        .withColumn("boundary_observation", (x == 0) | (x == n))
        .withColumn("kupiec_lr", kupiec_ratio(n, x, alpha))
        .withColumn("kupiec_p_value", chi_square_tail(F.col("kupiec_lr")))
        .withColumn("kupiec_reject", F.col("kupiec_p_value") < significance)
        .withColumn("kupiec_decision", F.when(F.col("kupiec_reject"), "reject_H0").otherwise("do_not_reject_H0"))
    )


def transition_counts(predictions: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """First-order transitions of the violation flag in session order."""
    w = Window.partitionBy(*group).orderBy("target_date")
    steps = predictions.select(*group, hit().alias("_now"), F.lag(hit()).over(w).alias("_then"))
    then, now = F.col("_then"), F.col("_now")
    return steps.filter(then.isNotNull()).groupBy(*group).agg(
        F.count_if(~then & ~now).alias("n00"),
        F.count_if(~then & now).alias("n01"),
        F.count_if(then & ~now).alias("n10"),
        F.count_if(then & now).alias("n11"),
    )


def with_independence(counts: DataFrame) -> DataFrame:
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    pooled = (n01 + n11) / (n00 + n01 + n10 + n11)
    after_calm = F.coalesce(F.try_divide(n01, n00 + n01), F.lit(0.0))
    after_hit = F.coalesce(F.try_divide(n11, n10 + n11), F.lit(0.0))
    restricted = x_log_p(n01 + n11, pooled) + x_log_p(n00 + n10, 1 - pooled)
    free = (
        x_log_p(n01, after_calm) + x_log_p(n00, 1 - after_calm) + x_log_p(n11, after_hit) + x_log_p(n10, 1 - after_hit)
    )
    return counts.withColumn("lr_ind", F.greatest(F.lit(0.0), F.lit(2.0) * (free - restricted))).withColumn(
        "p_ind", chi_square_tail(F.col("lr_ind"))
    )


def christoffersen_ind(predictions: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    return with_independence(transition_counts(predictions, group))


def conditional_coverage(predictions: DataFrame, group: Sequence[str] = GROUP, alpha: float = ALPHA) -> DataFrame:
    """Joint test: both ratios add up and the tail has two degrees of freedom."""
    coverage = kupiec_uc(predictions, group, alpha).select(
        *group, "n_targets", "n_violations", "violation_rate",
        F.col("kupiec_lr").alias("lr_uc"), F.col("kupiec_p_value").alias("p_uc"),
    )
    return (
        coverage.join(christoffersen_ind(predictions, group), list(group))
        .withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
        .withColumn("p_cc", F.exp(-F.col("lr_cc") / 2.0))
    )


def backtest_summary(predictions: DataFrame, group: Sequence[str] = GROUP, alpha: float = ALPHA,
                     significance: float = 0.05) -> DataFrame:
    counts = predictions.groupBy(*group).agg(*summary_columns(alpha))
    return (
        with_kupiec(counts.drop("violation_rate"), alpha, significance)
        .withColumn("quantile_alpha", F.lit(alpha))
        .withColumn("nominal_coverage", F.lit(1.0 - alpha))
        .withColumn("coverage", F.lit(1.0) - F.col("violation_rate"))
    )
