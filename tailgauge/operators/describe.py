"""Descriptive statistics of bars and returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import filter_period
from .features import descriptive_rolling_vol
from .returns import price_drawdown, simple_return

TRADING_DAYS = 252.0
TAILS = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def panel_overview(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_if(F.col("close").isNull()).alias("missing_close"),
    )


def sample_skew(value: str) -> Column:
    n, g = F.count(value), F.skewness(value)
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: str) -> Column:
    """Bias-corrected excess kurtosis from the population moment."""
    n, g = F.count(value).cast("double"), F.kurtosis(value)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def return_moments(returns: DataFrame, value: str = "log_return") -> DataFrame:
    return returns.groupBy("ticker").agg(
        F.count(value).alias("observations"),
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        sample_skew(value).alias("skewness"),
        sample_kurtosis(value).alias("excess_kurtosis"),
    )


def return_quantiles(returns: DataFrame, value: str = "log_return") -> DataFrame:
    """Seven quantiles per ticker from one percentile buffer."""
    return (
        returns.groupBy("ticker")
        .agg(F.percentile(value, F.lit(list(TAILS.values()))).alias("_q"))
        .select("ticker", *[F.col("_q")[i].alias(name) for i, name in enumerate(TAILS)])
    )


def zero_return_share(returns: DataFrame, value: str = "simple_return") -> DataFrame:
    return returns.groupBy("ticker").agg(
        F.count(value).alias("observations"),
        F.count_if(F.col(value) == 0).alias("zero_days"),
        (F.count_if(F.col(value) == 0) / F.count(value)).alias("zero_share"),
    )


def return_sign_table(returns: DataFrame, value: str = "simple_return") -> DataFrame:
    """Counts and shares of negative, zero and positive returns, absent signs as zero."""
    signs = {"negative": F.col(value) < 0, "zero": F.col(value) == 0, "positive": F.col(value) > 0}
    n = F.count(value)
    return returns.groupBy("ticker").agg(
        *[F.count_if(test).alias(f"{name}_days") for name, test in signs.items()],
        *[(F.count_if(test) / n).alias(f"{name}_share") for name, test in signs.items()],
    )


def iqr_fences(returns: DataFrame, value: str = "log_return", width: float = 1.5) -> DataFrame:
    quartiles = returns.groupBy("ticker").agg(F.percentile(value, F.lit([0.25, 0.75])).alias("_q"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    return quartiles.select(
        "ticker",
        low.alias("q25"),
        high.alias("q75"),
        (low - width * (high - low)).alias("lower_fence"),
        (high + width * (high - low)).alias("upper_fence"),
    )


def iqr_outliers(returns: DataFrame, value: str = "log_return", width: float = 1.5) -> DataFrame:
    """Rows outside the fences with their magnitude."""
    outside = (F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence"))
    return (
        returns.join(iqr_fences(returns, value, width), "ticker")
        .filter(outside)
        .select("ticker", "date", value, F.abs(value).alias("absolute_return"), "lower_fence", "upper_fence")
    )


def iqr_outlier_summary(returns: DataFrame, value: str = "log_return", width: float = 1.5) -> DataFrame:
    outside = (F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence"))
    valid = returns.filter(F.col(value).isNotNull())
    return valid.join(iqr_fences(returns, value, width), "ticker").groupBy(
        "ticker", "q25", "q75", "lower_fence", "upper_fence"
    ).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min(value).alias("minimum_return"),
        F.min_by("date", F.struct(value, "date")).alias("minimum_date"),
        F.max(value).alias("maximum_return"),
        F.max_by("date", F.struct(F.col(value), -F.unix_date("date"))).alias("maximum_date"),
        F.count_if(outside).alias("iqr_outlier_rows"),
    )


def correlation_matrix(wide: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of complete rows, long form.

    ``wide`` has one row per session; all pairs of the given columns come from
    one aggregation, so no session is joined with itself.
    """
    complete = F.lit(True)
    for name in columns:
        complete = complete & F.col(f"`{name}`").isNotNull()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    measured = wide.filter(complete).groupBy(*group).agg(
        *[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            value = F.lit(1.0) if a == b else F.col(f"_c{i}")
            cells.append(F.struct(F.lit(left).alias("left"), F.lit(right).alias("right"), value.alias("correlation")))
    return measured.select(*group, F.inline(F.array(*cells)))


def rolling_vol_summary(returns: DataFrame, windows: Sequence[int] = (20, 60), value: str = "log_return") -> DataFrame:
    """Valid and missing sessions, level and peak of the descriptive volatility."""
    vol = descriptive_rolling_vol(returns, windows, ("ticker",), value)
    rows = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"vol_{n}").alias("vol")) for n in windows])
    return vol.select("ticker", "date", F.inline(rows)).groupBy("ticker", "window").agg(
        F.count("vol").alias("valid"),
        F.count_if(F.col("vol").isNull()).alias("missing"),
        F.avg("vol").alias("mean_vol"),
        F.percentile("vol", F.lit(0.5)).alias("median_vol"),
        F.max("vol").alias("max_vol"),
        F.max_by("date", F.when(F.col("vol").isNotNull(), F.struct(F.col("vol"), -F.unix_date("date")))).alias(
            "max_vol_date"
        ),
    )


def left_tail_rows(returns: DataFrame, alpha: float = 0.05, value: str = "log_return") -> DataFrame:
    """Rows at or below the alpha quantile of their ticker."""
    cut = returns.groupBy("ticker").agg(F.percentile(value, F.lit(alpha)).alias("_cut"))
    return returns.join(cut, "ticker").filter(F.col(value) <= F.col("_cut")).drop("_cut")


def left_tail(returns: DataFrame, alpha: float = 0.05, value: str = "log_return") -> DataFrame:
    return left_tail_rows(returns, alpha, value).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("left_tail_rows"),
        F.min("date").alias("earliest_tail_date"),
        F.max("date").alias("latest_tail_date"),
        (F.min(value) * 100.0).alias("worst_tail_return_pct"),
    )


def histogram(returns: DataFrame, value: str = "log_return", bins: int | None = None) -> DataFrame:
    """Counts per bin, Freedman-Diaconis width unless a bin number is given.

    Bin i covers [low + i * width, low + (i + 1) * width); the last one includes
    its upper edge, so that the counts add up to the number of observations.
    """
    present = returns.filter(F.col(value).isNotNull())
    shape = present.groupBy("ticker").agg(
        F.min(value).alias("_low"),
        F.max(value).alias("_high"),
        F.count(F.lit(1)).alias("_n"),
        F.percentile(value, F.lit([0.25, 0.75])).alias("_q"),
    )
    span = F.col("_high") - F.col("_low")
    if bins is None:
        wide = F.lit(2.0) * (F.col("_q")[1] - F.col("_q")[0]) / F.pow(F.col("_n").cast("double"), F.lit(1.0 / 3.0))
        number = F.greatest(F.coalesce(F.ceil(F.try_divide(span, wide)), F.lit(1)), F.lit(1))
    else:
        number = F.lit(bins).cast("long")
    edges = shape.select("ticker", "_low", "_high", number.alias("bins"))
    place = F.floor(
        F.coalesce(F.try_divide((F.col(value) - F.col("_low")) * F.col("bins"), F.col("_high") - F.col("_low")),
                   F.lit(0.0))
    )
    width = (F.col("_high") - F.col("_low")) / F.col("bins")
    return (
        present.join(edges, "ticker")
        .withColumn("bin", F.least(place, F.col("bins") - 1))
        .groupBy("ticker", "bins", "bin", "_low", "_high")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("ticker", "bins", "bin", (F.col("_low") + F.col("bin") * width).alias("left_edge"), "n")
    )


def stock_kpis(bars: DataFrame, period: str = "1Y") -> DataFrame:
    """Return, annualised volatility, drawdown and day statistics of the chosen period."""
    chosen = filter_period(bars, period)
    rows = simple_return(chosen).join(price_drawdown(chosen), ["ticker", "date"])
    return rows.groupBy("ticker").agg(
        F.max_by("close", "date").alias("latest_close"),
        (F.max_by("close", "date") / F.min_by("close", "date") - 1.0).alias("period_return"),
        (F.stddev_samp("simple_return") * F.sqrt(F.lit(TRADING_DAYS))).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("simple_return").alias("best_day"),
        F.min("simple_return").alias("worst_day"),
        (F.count_if(F.col("simple_return") > 0) / F.count("simple_return")).alias("positive_day_ratio"),
    )


def sample_sections(df: DataFrame, n: int, key: str = "series_id", order: str = "date") -> DataFrame:
    """First, middle and last n rows of every series, each row once."""
    w = Window.partitionBy(key).orderBy(order)
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    start = F.floor(F.col("_size") / 2) - F.floor(F.lit(n) / 2)
    inside = (
        (F.col("position") < n)
        | ((F.col("position") >= start) & (F.col("position") < start + n))
        | (F.col("position") >= F.col("_size") - n)
    )
    return (
        df.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("_size", size)
        .filter(inside)
        .drop("_size")
    )
