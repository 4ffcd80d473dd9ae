"""One-step walk-forward forecasts with pluggable forecasters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import is_violation, normal_quantile, var_from_quantile
from ..operators.blocked import with_window_columns
from ..operators.expanding import expanding_quantile
from .historical import window_quantile
from .ewma import ewma_path

Forecaster = Callable[[WindowSpec], Column]


def empirical_quantile(alpha: float = 0.05) -> Forecaster:
    """Linear quantile of the frame; its ``alpha`` lets an expanding run take it from order statistics."""

    def forecast(frame: WindowSpec) -> Column:
        return F.percentile("ret", F.lit(alpha)).over(frame)

    forecast.alpha = alpha
    return forecast


def normal_moments(alpha: float = 0.05) -> Forecaster:
    """Mean plus z times the sample deviation of the frame."""
    z = normal_quantile(alpha)
    return lambda frame: F.avg("ret").over(frame) + F.lit(z) * F.stddev_samp("ret").over(frame)


def python_forecaster(function: Callable[[pd.Series], float]) -> Forecaster:
    """A user function of the training returns, run on Arrow batches per frame."""

    @F.pandas_udf("double")
    def forecast(values: pd.Series) -> float:
        return float(function(values))

    return lambda frame: forecast("ret").over(frame)


def walk_forward(returns: DataFrame, forecaster: Forecaster, window: int = 250, mode: str = "rolling",
                 block: int | None = None) -> DataFrame:
    """Forecast each session from strictly earlier returns.

    rolling: the last ``window`` sessions; expanding: all earlier sessions, from
    ``window`` on.  A rolling run can be cut into halo chunks with ``block``, and so
    can an expanding run of :func:`empirical_quantile` (see :mod:`..operators.expanding`);
    another forecaster needs all of its past.
    """
    if mode not in ("rolling", "expanding"):
        raise ValueError("mode must be rolling or expanding")
    if mode == "expanding" and block is not None:
        if not hasattr(forecaster, "alpha"):
            raise ValueError("an expanding frame of this forecaster cannot be cut into chunks")
        past = with_window_columns(returns, lambda w: {"as_of": F.lag("date").over(w)}, 1, block=block)
        starts = returns.groupBy("series_id").agg(F.min("date").alias("train_start"))
        found = expanding_quantile(past, forecaster.alpha, window, block).withColumnRenamed("seen", "train_rows")
        return as_predictions(found.join(starts, "series_id"), "as_of", "train_start", "train_rows")

    def build(w: WindowSpec) -> dict[str, Column]:
        start = -window if mode == "rolling" else Window.unboundedPreceding
        frame = w.rowsBetween(start, -1)
        seen = F.count("ret").over(frame)
        quantile = forecaster(frame)
        return {
            "as_of": F.max("date").over(frame),
            "train_start": F.min("date").over(frame),
            "train_rows": seen,
            "quantile_return": F.when(seen >= window, quantile),
        }

    return as_predictions(
        with_window_columns(returns, build, window, block=block).filter(F.col("quantile_return").isNotNull()),
        "as_of", "train_start", "train_rows",
    )


def as_predictions(forecasts: DataFrame, *extra: str) -> DataFrame:
    """Add the outcome columns every forecast table carries."""
    return forecasts.select(
        "series_id",
        *extra,
        F.col("date").alias("target_date"),
        F.col("ret").alias("actual_return"),
        "quantile_return",
        var_from_quantile(F.col("quantile_return")).alias("var"),
        is_violation(F.col("ret"), F.col("quantile_return")).alias("violation"),
    )


def compare_methods(returns: DataFrame, boosted: DataFrame, window: int = 250, decay: float = 0.94, alpha: float = 0.05,
                    block: int | None = None) -> DataFrame:
    """Historical simulation, EWMA and the forecasts of a boosted model on their common targets.

    ``boosted`` holds series_id, target_date and quantile_return, one row per target, as
    :func:`refits.walk_forward_model` gives them.  All forecasts of a session meet on one
    row, so target dates and actual returns are the same for every method by construction.
    """
    path = ewma_path(returns, decay=decay, alpha=alpha).withColumnRenamed("quantile_return", "_ewma")

    def build(w: WindowSpec) -> dict[str, Column]:
        return {"as_of": F.lag("date").over(w), "_long": window_quantile(w, window, alpha)}

    trees = boosted.select("series_id", F.col("target_date").alias("date"), F.col("quantile_return").alias("_boosted"))
    wide = (
        with_window_columns(path, build, window, block=block)
        .filter(F.col("_long").isNotNull() & F.col("_ewma").isNotNull())
        .join(trees.filter(F.col("_boosted").isNotNull()), ["series_id", "date"])
    )
    methods = F.array(
        F.struct(F.lit("historical_simulation").alias("method"), F.col("_long").alias("quantile_return")),
        F.struct(F.lit("ewma").alias("method"), F.col("_ewma").alias("quantile_return")),
        F.struct(F.lit("gradient_boosting").alias("method"), F.col("_boosted").alias("quantile_return")),
    )
    long = wide.select("series_id", "as_of", "date", "ret", F.inline(methods))
    return as_predictions(long, "method", "as_of").select(
        "series_id", "method", "as_of", "target_date", "actual_return", "quantile_return", "var", "violation"
    )
