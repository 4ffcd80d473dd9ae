"""Zero-mean EWMA-normal forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal_quantile, var_from_quantile
from ..operators.blocked import SLICE_DAYS, with_ewma_variance


def ewma_var(returns: DataFrame, alpha: float = 0.05, decay: float = 0.94) -> DataFrame:
    """Forecast for the session after the last return of each series."""
    states = with_ewma_variance(returns, decay=decay)
    return (
        states.groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("observations"),
            F.max("date").alias("forecast_date"),
            F.max_by("variance_after", "date").alias("variance"),
        )
        .withColumn("quantile_return", F.lit(normal_quantile(alpha)) * F.sqrt("variance"))
        .withColumn("var", var_from_quantile(F.col("quantile_return")))
    )


def ewma_path(returns: DataFrame, warmup: int = 1, decay: float = 0.94, alpha: float = 0.05,
              days: int = SLICE_DAYS) -> DataFrame:
    """Forecast for every session, made before its return enters the state.

    ``warmup`` sessions at the start get none.
    """
    states = with_ewma_variance(returns, decay=decay, days=days)
    quantile = F.lit(normal_quantile(alpha)) * F.sqrt("variance_before")
    if warmup > 1:
        order = F.row_number().over(Window.partitionBy("series_id").orderBy("date"))
        states = states.withColumn("_order", order)
        quantile = F.when(F.col("_order") > warmup, quantile)
    return states.withColumn("quantile_return", quantile).drop("_order", "variance_before", "variance_after")


def decay_grid(returns: DataFrame, decays: Sequence[float], alpha: float = 0.05) -> DataFrame:
    """Forecasts of several decays, one row per (decay, series, session)."""
    result = None
    for decay in decays:
        path = ewma_path(returns, decay=decay, alpha=alpha).withColumn("decay", F.lit(float(decay)))
        result = path if result is None else result.unionByName(path)
    return result
