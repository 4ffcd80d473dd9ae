"""Historical simulation: linear-interpolated empirical quantiles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import before, full_window_quantile, var_from_quantile
from ..operators.blocked import with_window_columns


def historical_var(returns: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Unconditional quantile and VaR of every series."""
    return returns.groupBy("series_id").agg(
        F.count("ret").alias("observations"), F.percentile("ret", F.lit(alpha)).alias("quantile_return")
    ).withColumn("var", var_from_quantile(F.col("quantile_return")))


def window_quantile(w: WindowSpec, window: int, alpha: float = 0.05) -> Column:
    return full_window_quantile("ret", before(w, window), window, alpha)


def rolling_historical_var(returns: DataFrame, window: int = 250, confidence: float = 0.95,
                           block: int | None = None) -> DataFrame:
    """One-step forecasts: the window ends at the session before the target."""
    alpha = round(1.0 - confidence, 12)

    def build(w: WindowSpec) -> dict[str, Column]:
        f = before(w, window)
        return {
            "window_start_date": F.min("date").over(f),
            "window_end_date": F.max("date").over(f),
            "observations": F.count("ret").over(f),
            "quantile_return": window_quantile(w, window, alpha),
        }

    return (
        with_window_columns(returns, build, window, block=block)
        .filter(F.col("quantile_return").isNotNull())
        .select(
            "series_id",
            "window_start_date",
            "window_end_date",
            F.col("window_end_date").alias("forecast_date"),
            F.col("date").alias("target_date"),
            "observations",
            "quantile_return",
            var_from_quantile(F.col("quantile_return")).alias("historical_var"),
            F.col("ret").alias("target_return"),
        )
    )


def window_grid(returns: DataFrame, windows: Mapping[str, int], alpha: float = 0.05,
                block: int | None = None) -> DataFrame:
    """Quantiles of several window lengths side by side, from one sort."""
    return with_window_columns(
        returns,
        lambda w: {name: window_quantile(w, size, alpha) for name, size in windows.items()},
        max(windows.values()),
        block=block,
    )
