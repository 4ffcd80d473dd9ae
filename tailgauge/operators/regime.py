"""Volatility regimes with thresholds from history before the evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ALPHA, before, ordered_by, when_full
from .metrics import hit, loss

REGIMES = ["LOW", "NORMAL", "HIGH"]


def prior_volatility(returns: DataFrame, window: int = 20) -> DataFrame:
    f = before(ordered_by("series_id"), window)
    return returns.select(
        "series_id",
        F.col("date").alias("target_date"),
        when_full(F.stddev_samp("ret").over(f), "ret", f, window).alias("prior_vol"),
    )


def volatility_regime(returns: DataFrame, predictions: DataFrame, window: int = 20,
                      low: float = 1.0 / 3.0, high: float = 2.0 / 3.0) -> DataFrame:
    """Predictions with the regime of their target and the two thresholds of their series.

    A target without volatility, or a series without thresholds, is an error.
    """
    prior = prior_volatility(returns, window)
    starts = predictions.groupBy("series_id").agg(F.min("target_date").alias("_start"))
    bounds = (
        prior.join(starts, "series_id")
        .filter(F.col("target_date") < F.col("_start"))
        .groupBy("series_id")
        .agg(
            F.percentile("prior_vol", F.lit(low)).alias("low_vol_threshold"),
            F.percentile("prior_vol", F.lit(high)).alias("high_vol_threshold"),
        )
    )
    classified = (
        predictions.join(prior, ["series_id", "target_date"], "left")
        .join(bounds, "series_id", "left")
        .withColumn(
            "regime",
            F.when(F.col("prior_vol") < F.col("low_vol_threshold"), "LOW")
            .when(F.col("prior_vol") > F.col("high_vol_threshold"), "HIGH")
            .when(F.col("prior_vol").isNotNull() & F.col("low_vol_threshold").isNotNull(), "NORMAL"),
        )
    )
    missing = classified.filter(F.col("regime").isNull()).limit(1).collect()
    if missing:
        raise ValueError(f"no volatility regime for {missing[0]['series_id']} on {missing[0]['target_date']}")
    return classified


def regime_metrics(classified: DataFrame, alpha: float = ALPHA) -> DataFrame:
    rate = F.count_if(hit()) / F.count(F.lit(1))
    return classified.groupBy("series_id", "regime", "method").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(hit()).alias("violation_count"),
        rate.alias("violation_rate"),
        F.avg(loss(alpha)).alias("pinball_loss"),
        F.avg("var").alias("average_var"),
        F.avg("actual_return").alias("average_actual_return"),
        F.abs(rate - alpha).alias("calibration_distance"),
    )


def regime_pivot(metrics: DataFrame, methods: list[str]) -> DataFrame:
    """Violation rate per regime and method, regimes in fixed order."""
    order = F.array_position(F.array(*[F.lit(r) for r in REGIMES]), F.col("regime"))
    return (
        metrics.groupBy("series_id", "regime")
        .pivot("method", methods)
        .agg(F.first("violation_rate"))
        .withColumn("regime_order", order)
        .orderBy("series_id", "regime_order")
    )
