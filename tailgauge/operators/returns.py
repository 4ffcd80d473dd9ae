"""Returns, weights and portfolio construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finite, ordered_by, so_far
from .alignment import align_calendars, calendar_mismatch
from .blocked import with_running_log_wealth, with_window_columns


def _change(w) -> Column:
    return F.try_divide(F.col("close"), F.lag("close").over(w)) - F.lit(1.0)


def simple_return(bars: DataFrame, keys: Sequence[str] = ("ticker",), block: int | None = None) -> DataFrame:
    """P_t / P_{t-1} - 1; the first session of a ticker has none."""
    return with_window_columns(bars, lambda w: {"simple_return": _change(w)}, 1, keys=keys, block=block)


def log_return(bars: DataFrame, keys: Sequence[str] = ("ticker",), block: int | None = None) -> DataFrame:
    return with_window_columns(
        bars,
        lambda w: {"log_return": F.ln(F.try_divide(F.col("close"), F.lag("close").over(w)))},
        1,
        keys=keys,
        block=block,
    )


def both_returns(bars: DataFrame, keys: Sequence[str] = ("ticker",), block: int | None = None) -> DataFrame:
    """Simple and log return from one shared sort."""
    return with_window_columns(
        bars,
        lambda w: {
            "simple_return": _change(w),
            "log_return": F.ln(F.try_divide(F.col("close"), F.lag("close").over(w))),
        },
        1,
        keys=keys,
        block=block,
    )


def equal_weights(members: DataFrame, portfolio: str = "portfolio_id") -> DataFrame:
    """1/n for each distinct, upper-cased member of a portfolio."""
    names = members.select(portfolio, F.upper(F.trim("ticker")).alias("ticker")).distinct()
    sizes = names.groupBy(portfolio).agg(F.count(F.lit(1)).alias("_n"))
    return names.join(sizes, portfolio).select(portfolio, "ticker", (F.lit(1.0) / F.col("_n")).alias("weight"))


def validate_weights(weights: DataFrame, tolerance: float = 1e-12, portfolio: str = "portfolio_id") -> DataFrame:
    """Violations per portfolio: non-finite, negative, repeated tickers, sum other than one."""
    per_ticker = weights.groupBy(portfolio, "ticker").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(~finite(F.col("weight"))).alias("_bad"),
        F.count_if(F.col("weight") < 0).alias("_negative"),
        F.sum("weight").alias("_weight"),
    )
    return per_ticker.groupBy(portfolio).agg(
        F.count(F.lit(1)).alias("tickers"),
        F.sum("_bad").alias("not_finite"),
        F.sum("_negative").alias("negative"),
        F.count_if(F.col("_copies") > 1).alias("repeated"),
        F.sum("_weight").alias("weight_sum"),
    ).withColumn(
        "valid",
        (F.col("not_finite") == 0)
        & (F.col("negative") == 0)
        & (F.col("repeated") == 0)
        & (F.abs(F.col("weight_sum") - 1.0) <= tolerance),
    )


def portfolio_return(returns: DataFrame, weights: DataFrame, portfolio: str = "portfolio_id",
                     value: str = "simple_return") -> DataFrame:
    """Weighted return per date; incomplete dates are reported, not filled.

    Partial sums combine on the map side, so a portfolio with many members costs
    one row per (portfolio, date) and task in the shuffle.
    """
    sizes = weights.groupBy(portfolio).agg(F.count(F.lit(1)).alias("_members"))
    summed = (
        returns.select("ticker", "date", value)
        .join(weights, "ticker")
        .groupBy(portfolio, "date")
        .agg(
            F.sum(F.col("weight") * F.col(value)).alias("_sum"),
            F.count(value).alias("_present"),
        )
    )
    return summed.join(sizes, portfolio).select(
        portfolio,
        "date",
        F.when(F.col("_present") == F.col("_members"), F.col("_sum")).alias("portfolio_simple_return"),
        (F.col("_present") == F.col("_members")).alias("complete"),
    )


def portfolio_log_return(portfolio: DataFrame, value: str = "portfolio_simple_return") -> DataFrame:
    """log1p of the simple return; NULL outside the domain r > -1."""
    return portfolio.withColumn(
        "portfolio_log_return", F.when(F.col(value) > -1.0, F.log1p(value))
    )


def build_portfolio(bars: DataFrame, tickers: int) -> DataFrame:
    """Equal-weight portfolio of a panel on one calendar.

    A bar that repeats is refused, because it would add a return of zero; so is a
    session that some ticker misses, because the next return would span the gap; and
    a portfolio return of -1 or less, which has no logarithm.
    """
    again = bars.groupBy("ticker", "date").count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{again[0]['count']} bars of {again[0]['ticker']} on {again[0]['date']}")
    gap = calendar_mismatch(bars, tickers).limit(1).collect()
    if gap:
        raise ValueError(f"calendars differ on {gap[0]['date']}: {gap[0]['tickers']} of {tickers} tickers")
    per_date = (
        simple_return(bars)
        .groupBy("date")
        .agg(F.avg("simple_return").alias("portfolio_simple_return"))
        .filter(F.col("portfolio_simple_return").isNotNull())
    )
    lost = per_date.filter("portfolio_simple_return <= -1").limit(1).collect()
    if lost:
        raise ValueError(f"portfolio return of {lost[0]['portfolio_simple_return']} on {lost[0]['date']}")
    return portfolio_log_return(per_date)


def portfolio_series(bars: DataFrame, weights: DataFrame, tickers: int | None = None) -> DataFrame:
    """(series_id, date, ret) of every portfolio: the input of features and forecasts."""
    returns = simple_return(align_calendars(bars, tickers)).filter(F.col("simple_return").isNotNull())
    return (
        portfolio_return(returns, weights)
        .filter("complete")
        .select(F.col("portfolio_id").alias("series_id"), "date", F.col("portfolio_simple_return").alias("ret"))
    )


def return_identity(returns: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """log return against log1p(simple return), per ticker."""
    gap = F.abs(F.col("log_return") - F.log1p("simple_return"))
    return returns.groupBy("ticker").agg(
        F.count("log_return").alias("valid"),
        F.max(gap).alias("max_abs_difference"),
        F.avg(gap).alias("mean_abs_difference"),
        F.count_if(gap > tolerance).alias("offenders"),
    )


def jensen_gap(returns: DataFrame, weights: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """log1p(portfolio return) minus the weighted log returns, summarised per portfolio."""
    per_date = (
        returns.select("ticker", "date", "simple_return", "log_return")
        .dropna()
        .join(weights, "ticker")
        .groupBy("portfolio_id", "date")
        .agg(
            F.sum(F.col("weight") * F.col("simple_return")).alias("_simple"),
            F.sum(F.col("weight") * F.col("log_return")).alias("_log"),
        )
        .withColumn("gap", F.log1p("_simple") - F.col("_log"))
    )
    return per_date.groupBy("portfolio_id").agg(
        F.count("gap").alias("comparisons"),
        F.min("gap").alias("minimum_gap"),
        F.max("gap").alias("maximum_gap"),
        F.avg("gap").alias("mean_gap"),
        F.count_if(F.col("gap") < -tolerance).alias("negative_gaps"),
        F.count_if(F.abs("gap") <= tolerance).alias("near_zero_gaps"),
        # gaps are equal up to rounding where nothing is diversified: then the first date counts
        F.max_by("date", F.struct(F.round("gap", 12) + F.lit(0.0), -F.unix_date("date"))).alias("maximum_gap_date"),
    )


def return_matrix(returns: DataFrame, tickers: Sequence[str], value: str = "simple_return") -> DataFrame:
    """date x ticker; the column list is explicit, so no extra pass finds it."""
    wide = returns.groupBy("date").pivot("ticker", list(tickers)).agg(F.first(value))
    complete = F.lit(True)
    for name in tickers:
        complete = complete & F.col(f"`{name}`").isNotNull()
    return wide.withColumn("complete", complete)


def normalized_price(bars: DataFrame, base: float = 100.0) -> DataFrame:
    """Close relative to the first close of the ticker."""
    first = so_far(ordered_by("ticker"))
    return bars.select(
        "ticker", "date", (F.col("close") / F.first("close").over(first) * F.lit(base)).alias("normalized_close")
    )


def performance_summary(bars: DataFrame) -> DataFrame:
    summary = bars.groupBy("ticker").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
    )
    return summary.withColumn(
        "change_pct", (F.col("last_close") / F.col("first_close") - 1.0) * 100.0
    ).orderBy(F.desc("change_pct"), "ticker")


def wealth_drawdown(returns: DataFrame) -> DataFrame:
    """Wealth, running peak (initial capital 1 included) and drawdown, in log space."""
    run = with_running_log_wealth(returns)
    peak = F.greatest(F.lit(0.0), F.col("log_peak"))
    return run.select(
        "series_id",
        "date",
        F.col("log_wealth"),
        peak.alias("log_peak"),
        (F.exp(F.col("log_wealth") - peak) - 1.0).alias("drawdown"),
    )


def drawdown_trough(drawdown: DataFrame) -> DataFrame:
    return drawdown.groupBy("series_id").agg(
        F.min("drawdown").alias("max_drawdown"), F.min_by("date", F.struct("drawdown", "date")).alias("trough_date")
    )


def price_drawdown(bars: DataFrame) -> DataFrame:
    """Close against its running maximum."""
    peak = F.max("close").over(so_far(ordered_by("ticker")))
    return bars.select("ticker", "date", (F.col("close") / peak - 1.0).alias("drawdown"))


def return_rebuild_check(bars: DataFrame, weights: DataFrame, stored: DataFrame, tickers: int, tolerance: float = 1e-12) -> DataFrame:
    """Returns of every portfolio rebuilt from prices against stored ones (series_id, date, ret)."""
    rebuilt = portfolio_series(bars, weights, tickers).select("series_id", "date", F.col("ret").alias("_a"))
    joined = rebuilt.join(stored.select("series_id", "date", F.col("ret").alias("_b")), ["series_id", "date"], "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return joined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(gap.isNull()).alias("unmatched"),
        F.count_if(gap > tolerance).alias("offenders"),
    )
