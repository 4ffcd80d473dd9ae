"""Lagged features: every frame ends one session before the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import before, ending_here, full_window_quantile, ordered_by, so_far, when_full
from .alignment import align_calendars
from .blocked import with_running_log_wealth, with_window_columns

FEATURES_7 = [
    "return_lag_1", "return_lag_2", "return_lag_5", "rolling_vol_5", "rolling_vol_20", "rolling_vol_60", "drawdown",
]
FEATURES_12 = [*FEATURES_7, "momentum_5", "momentum_20", "downside_vol_20", "rolling_q05_60", "rolling_range_20"]
MARKET_FEATURES = [
    "portfolio_range", "volume_change", "relative_volume_20",
    "market_return_lag_1", "market_return_lag_5", "market_vol_20",
]
KEYS = ("series_id",)


def lag_columns(w: WindowSpec, lags: Sequence[int] = (1, 2, 5)) -> dict[str, Column]:
    return {f"return_lag_{k}": F.lag("ret", k).over(w) for k in lags}


def volatility_columns(w: WindowSpec, windows: Sequence[int] = (5, 20, 60)) -> dict[str, Column]:
    return {
        f"rolling_vol_{n}": when_full(F.stddev_samp("ret").over(before(w, n)), "ret", before(w, n), n)
        for n in windows
    }


def momentum_columns(w: WindowSpec, windows: Sequence[int] = (5, 20)) -> dict[str, Column]:
    return {
        f"momentum_{n}": when_full(F.expm1(F.sum(F.log1p("ret")).over(before(w, n))), "ret", before(w, n), n)
        for n in windows
    }


def downside_columns(w: WindowSpec, n: int = 20) -> dict[str, Column]:
    low = F.least(F.col("ret"), F.lit(0.0))
    return {f"downside_vol_{n}": when_full(F.sqrt(F.avg(low * low).over(before(w, n))), "ret", before(w, n), n)}


def quantile_columns(w: WindowSpec, n: int = 60, alpha: float = 0.05) -> dict[str, Column]:
    name = f"rolling_q{int(round(alpha * 100)):02d}_{n}"
    return {name: full_window_quantile("ret", before(w, n), n, alpha)}


def range_columns(w: WindowSpec, n: int = 20) -> dict[str, Column]:
    f = before(w, n)
    return {f"rolling_range_{n}": when_full(F.max("ret").over(f) - F.min("ret").over(f), "ret", f, n)}


def return_lags(returns: DataFrame, block: int | None = None) -> DataFrame:
    return with_window_columns(returns, lag_columns, 5, block=block)


def rolling_vol(returns: DataFrame, block: int | None = None) -> DataFrame:
    return with_window_columns(returns, volatility_columns, 60, block=block)


def momentum(returns: DataFrame, block: int | None = None) -> DataFrame:
    return with_window_columns(returns, momentum_columns, 20, block=block)


def downside_vol(returns: DataFrame, block: int | None = None) -> DataFrame:
    return with_window_columns(returns, downside_columns, 20, block=block)


def rolling_quantile(returns: DataFrame, block: int | None = None) -> DataFrame:
    return with_window_columns(returns, quantile_columns, 60, block=block)


def rolling_range(returns: DataFrame, block: int | None = None) -> DataFrame:
    return with_window_columns(returns, range_columns, 20, block=block)


def lagged_drawdown(returns: DataFrame, block: int | None = None) -> DataFrame:
    """Drawdown up to the previous session, the peak starting at the first wealth value."""
    run = with_running_log_wealth(returns).withColumn(
        "_drawdown", F.exp(F.col("log_wealth") - F.col("log_peak")) - 1.0
    )
    return with_window_columns(
        run, lambda w: {"drawdown": F.lag("_drawdown").over(w)}, 1, block=block
    ).drop("_drawdown", "log_wealth", "log_peak")


def _feature_table(returns: DataFrame, names: Sequence[str], block: int | None) -> DataFrame:
    """All features of one table from one window sort (the running drawdown adds its slices)."""
    run = with_running_log_wealth(returns).withColumn(
        "_drawdown", F.exp(F.col("log_wealth") - F.col("log_peak")) - 1.0
    )

    def build(w: WindowSpec) -> dict[str, Column]:
        every = {
            "as_of": F.lag("date").over(w),
            **lag_columns(w),
            **volatility_columns(w),
            "drawdown": F.lag("_drawdown").over(w),
        }
        if len(names) > len(FEATURES_7):
            every |= {**momentum_columns(w), **downside_columns(w), **quantile_columns(w), **range_columns(w)}
        return every

    return with_window_columns(run, build, 60, block=block)


def feature_table_7f(returns: DataFrame, block: int | None = None) -> DataFrame:
    """Seven return features per target; warm-up rows stay missing."""
    return _feature_table(returns, FEATURES_7, block).select(
        "series_id", F.col("date").alias("target_date"), *FEATURES_7
    )


def feature_table_12f(returns: DataFrame, block: int | None = None) -> DataFrame:
    """Twelve features, the forecast origin and the outcome; complete rows only."""
    return (
        _feature_table(returns, FEATURES_12, block)
        .select(
            "series_id", F.col("date").alias("target_date"), "as_of", *FEATURES_12, F.col("ret").alias("actual_return")
        )
        .dropna()
    )


def portfolio_range(bars: DataFrame) -> DataFrame:
    """Mean of (high - low) / close over the tickers of a session."""
    return bars.groupBy("date").agg(
        F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("portfolio_range")
    )


def _volume_change(w: WindowSpec) -> Column:
    return F.try_divide("volume", F.lag("volume").over(w)) - F.lit(1.0)


def _relative_volume(w: WindowSpec, n: int) -> Column:
    f = ending_here(w, n)
    return when_full(F.try_divide(F.col("volume"), F.avg("volume").over(f)) - F.lit(1.0), "volume", f, n)


def _mean_or_missing(value: str) -> Column:
    return F.avg(value).alias(value)


def volume_change(bars: DataFrame) -> DataFrame:
    """Mean relative volume change; a ticker whose previous volume is zero is left out."""
    per_ticker = with_window_columns(bars, lambda w: {"volume_change": _volume_change(w)}, 1, keys=("ticker",))
    return per_ticker.groupBy("date").agg(_mean_or_missing("volume_change"))


def relative_volume(bars: DataFrame, n: int = 20) -> DataFrame:
    name = f"relative_volume_{n}"
    per_ticker = with_window_columns(bars, lambda w: {name: _relative_volume(w, n)}, n, keys=("ticker",))
    return per_ticker.groupBy("date").agg(_mean_or_missing(name))


def _index_return(index: DataFrame) -> DataFrame:
    w = ordered_by("ticker")
    return index.withColumn("_return", F.try_divide(F.col("close"), F.lag("close").over(w)) - F.lit(1.0))


def market_return_lags(index: DataFrame) -> DataFrame:
    """Index return at the source session and four sessions earlier."""
    w = ordered_by("ticker")
    return _index_return(index).select(
        "ticker",
        "date",
        F.col("_return").alias("market_return_lag_1"),
        F.lag("_return", 4).over(w).alias("market_return_lag_5"),
    )


def market_vol(index: DataFrame, n: int = 20) -> DataFrame:
    f = ending_here(ordered_by("ticker"), n)
    return _index_return(index).select(
        "ticker",
        "date",
        when_full(F.stddev_samp("_return").over(f), "_return", f, n).alias(f"market_vol_{n}"),
    )


def market_feature_table(bars: DataFrame, index: DataFrame, tickers: int) -> DataFrame:
    """Market features on the stocks' common calendar, moved to the next target session."""
    aligned = align_calendars(bars, tickers)
    per_ticker = with_window_columns(
        aligned,
        lambda w: {"_change": _volume_change(w), "_relative": _relative_volume(w, 20)},
        20,
        keys=("ticker",),
    )
    stocks = per_ticker.groupBy("date").agg(
        F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("portfolio_range"),
        F.avg("_change").alias("volume_change"),
        F.avg("_relative").alias("relative_volume_20"),
    )
    on_calendar = stocks.join(index.select("date", F.col("close").alias("_index")), "date", "left").withColumn(
        "market_id", F.lit("market")
    )
    w = ordered_by("market_id")
    moves = on_calendar.withColumn("_return", F.try_divide(F.col("_index"), F.lag("_index").over(w)) - F.lit(1.0))
    f = ending_here(w, 20)
    source = moves.select(
        "market_id",
        "date",
        "portfolio_range",
        "volume_change",
        "relative_volume_20",
        F.col("_return").alias("market_return_lag_1"),
        F.lag("_return", 4).over(w).alias("market_return_lag_5"),
        when_full(F.stddev_samp("_return").over(f), "_return", f, 20).alias("market_vol_20"),
    )
    return source.select(
        F.col("date").alias("target_date"), *[F.lag(name).over(w).alias(name) for name in MARKET_FEATURES]
    )


def descriptive_rolling_vol(returns: DataFrame, windows: Sequence[int] = (20, 60), keys: Sequence[str] = KEYS,
                            value: str = "ret", block: int | None = None) -> DataFrame:
    """Volatility that includes the session itself; for description, never for forecasts."""

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            f"vol_{n}": when_full(F.stddev_samp(value).over(ending_here(w, n)), value, ending_here(w, n), n)
            for n in windows
        }

    return with_window_columns(returns, build, max(windows), keys=keys, block=block)


def rolling_breach_rate(predictions: DataFrame, n: int = 60) -> DataFrame:
    f = ending_here(ordered_by("series_id", "method", order="target_date"), n)
    flag = F.col("violation").cast("int")
    return predictions.select(
        "series_id", "method", "target_date", when_full(F.avg(flag).over(f), flag, f, n).alias("breach_rate")
    )


def cumulative_violations(predictions: DataFrame) -> DataFrame:
    run = so_far(ordered_by("series_id", "method", order="target_date"))
    return predictions.select(
        "series_id",
        "method",
        "target_date",
        F.sum(F.col("violation").cast("long")).over(run).alias("cumulative_violations"),
        (~F.col("violation")).alias("covered"),
    )


def adjacent_var_changes(predictions: DataFrame) -> DataFrame:
    """Previous and next forecast VaR of each method and the changes to them."""
    w = ordered_by("series_id", "method", order="target_date")
    previous, following = F.lag("var").over(w), F.lead("var").over(w)
    return predictions.select(
        "series_id",
        "method",
        "target_date",
        "var",
        previous.alias("previous_var"),
        (F.col("var") - previous).alias("preceding_change"),
        following.alias("next_var"),
        (following - F.col("var")).alias("next_change"),
    )
