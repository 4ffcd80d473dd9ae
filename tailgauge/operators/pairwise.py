"""Pairwise loss differences of forecasting methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ALPHA
from .exceptions import KEY, METHOD_PREFIX
from .metrics import loss

TOLERANCE = 1e-15
# Compared pairs as (left prefix, right prefix).
PAIRS = (("gb", "historical"), ("gb", "ewma"), ("ewma", "historical"))


def pairwise_diagnostics(predictions: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per session: values per method, differences per pair, method of the lowest loss."""
    columns = [F.max("actual_return").alias("actual_return")]
    for method, prefix in METHOD_PREFIX.items():
        own = F.col("method") == method
        columns += [
            F.max(F.when(own, F.col("quantile_return"))).alias(f"{prefix}_quantile_return"),
            F.max(F.when(own, F.col("var"))).alias(f"{prefix}_var"),
            F.max(F.when(own, F.col("violation"))).alias(f"{prefix}_violation"),
            F.max(F.when(own, loss(alpha))).alias(f"{prefix}_pinball_loss"),
        ]
    wide = predictions.groupBy(KEY, "target_date").agg(*columns)
    deltas: dict[str, Column] = {}
    for a, b in PAIRS:
        deltas[f"{a}_minus_{b}_pinball"] = F.col(f"{a}_pinball_loss") - F.col(f"{b}_pinball_loss")
        deltas[f"{a}_minus_{b}_var"] = F.col(f"{a}_var") - F.col(f"{b}_var")
        deltas[f"abs_{a}_{b}_quantile_diff"] = F.abs(F.col(f"{a}_quantile_return") - F.col(f"{b}_quantile_return"))
    lowest = F.least(*[F.col(f"{p}_pinball_loss") for p in METHOD_PREFIX.values()])
    near = {m: F.abs(F.col(f"{p}_pinball_loss") - F.col("lowest_pinball_loss")) <= TOLERANCE
            for m, p in METHOD_PREFIX.items()}
    winners = sum((n.cast("int") for n in near.values()), F.lit(0))
    label = F.when(winners > 1, "tie")
    for method, is_near in near.items():
        label = label.when(is_near, method)
    return wide.withColumns(deltas).withColumn("lowest_pinball_loss", lowest).withColumn(
        "lowest_pinball_method", label
    )


def pair_deltas(diagnostics: DataFrame) -> DataFrame:
    """Long form: one row per (pair, session) with the loss difference and the gain of the left side."""
    rows = F.array(
        *[
            F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), F.col(f"{a}_minus_{b}_pinball").alias("delta"))
            for a, b in PAIRS
        ]
    )
    return diagnostics.select(KEY, "target_date", F.inline(rows)).withColumn(
        "gain", F.when(F.col("delta") < -TOLERANCE, -F.col("delta")).otherwise(0.0)
    )


def pairwise_reconcile(diagnostics: DataFrame, metrics: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """The mean of the session differences equals the difference of the method means."""
    means = pair_deltas(diagnostics).groupBy(KEY, "comparison").agg(F.avg("delta").alias("mean_delta"))
    of = {p: F.max(F.when(F.col("method") == m, F.col("pinball_loss"))) for m, p in METHOD_PREFIX.items()}
    expected = metrics.groupBy(KEY).agg(
        F.array(
            *[
                F.struct(F.lit(f"{a}_vs_{b}").alias("comparison"), (of[a] - of[b]).alias("metric_delta"))
                for a, b in PAIRS
            ]
        ).alias("_pairs")
    ).select(KEY, F.inline("_pairs"))
    return means.join(expected, [KEY, "comparison"]).withColumn(
        "reconciled", F.abs(F.col("mean_delta") - F.col("metric_delta")) <= tolerance
    )


def pairwise_summary(diagnostics: DataFrame) -> DataFrame:
    delta = F.col("delta")
    better, worse, tie = delta < -TOLERANCE, delta > TOLERANCE, F.abs(delta) <= TOLERANCE
    return pair_deltas(diagnostics).groupBy(KEY, "comparison").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(better).alias("left_better_count"),
        F.count_if(worse).alias("right_better_count"),
        F.count_if(tie).alias("tie_count"),
        (F.count_if(better) / F.count(F.lit(1))).alias("left_better_share"),
        F.avg(delta).alias("mean_delta"),
        F.percentile(delta, F.lit(0.5)).alias("median_delta"),
        F.avg(F.abs(delta)).alias("mean_absolute_delta"),
        F.sum("gain").alias("gross_left_improvement"),
        F.sum(F.when(worse, delta).otherwise(0.0)).alias("gross_left_deterioration"),
        F.sum(delta).alias("net_total_delta"),
        F.max("gain").alias("largest_left_improvement"),
        F.min_by("target_date", F.struct("delta", "target_date")).alias("largest_left_improvement_date"),
        F.max(F.when(worse, delta).otherwise(0.0)).alias("largest_left_deterioration"),
        F.max_by("target_date", F.struct(delta, -F.unix_date("target_date"))).alias("largest_left_deterioration_date"),
    )


def _ranked_gains(diagnostics: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY, "comparison").orderBy(F.desc("gain"), "target_date")
    return pair_deltas(diagnostics).select(
        KEY,
        "comparison",
        "gain",
        F.row_number().over(w).alias("_rank"),
        F.sum("gain").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cumulative"),
        F.sum("gain").over(Window.partitionBy(KEY, "comparison")).alias("_total"),
    )


def top_k_share(diagnostics: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Share of the total gain earned on the k best sessions."""
    ranked = _ranked_gains(diagnostics)
    return ranked.groupBy(KEY, "comparison").agg(
        *[
            F.coalesce(
                F.try_divide(F.sum(F.when(F.col("_rank") <= k, F.col("gain")).otherwise(0.0)), F.max("_total")),
                F.lit(0.0),
            ).alias(f"top_{k}_improvement_share")
            for k in ks
        ]
    )


def dates_to_fraction(diagnostics: DataFrame, fractions: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Number of best sessions needed for a fraction of the total gain; 0 when there is none."""
    ranked = _ranked_gains(diagnostics)
    return ranked.groupBy(KEY, "comparison").agg(
        *[
            F.coalesce(
                F.min(
                    F.when(
                        (F.col("gain") > TOLERANCE) & (F.col("_cumulative") >= F.lit(f) * F.col("_total")),
                        F.col("_rank"),
                    )
                ),
                F.lit(0),
            )
            .cast("long")
            .alias(f"improvement_dates_to_{int(round(f * 100))}pct")
            for f in fractions
        ]
    )
