"""Forecasts for the session after the last observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ewma import ewma_var
from .historical import historical_var


def last_sessions(returns: DataFrame, n: int) -> DataFrame:
    """The last n sessions of every series."""
    newest = Window.partitionBy("series_id").orderBy(F.desc("date"))
    return returns.withColumn("_recent", F.row_number().over(newest)).filter(F.col("_recent") <= n).drop("_recent")


def next_session_forecast(returns: DataFrame, window: int = 250, alpha: float = 0.05, decay: float = 0.94,
                          extra: DataFrame | None = None) -> DataFrame:
    """Historical simulation and EWMA (and any further model) for the next session."""
    recent = last_sessions(returns, window)
    origin = returns.groupBy("series_id").agg(F.max("date").alias("as_of"))
    simulated = (
        historical_var(recent, alpha)
        .filter(F.col("observations") == window)
        .join(origin, "series_id")
        .select("series_id", F.lit("historical_simulation").alias("method"), "as_of", "quantile_return", "var")
    )
    smoothed = ewma_var(returns, alpha, decay).select(
        "series_id",
        F.lit("ewma").alias("method"),
        F.col("forecast_date").alias("as_of"),
        "quantile_return",
        "var",
    )
    result = simulated.unionByName(smoothed)
    return result if extra is None else result.unionByName(extra.select(*result.columns))


def monetary_var(forecasts: DataFrame, value: Column | float) -> DataFrame:
    amount = F.lit(float(value)) if isinstance(value, (int, float)) else value
    return forecasts.withColumn("monetary_var", F.col("var") * amount)
