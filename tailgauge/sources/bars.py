"""Bar sources: text files, typed panels and candles computed from trades."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "volume"]
PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume"]


def read_ohlcv_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Read bar files untyped, with the file and the order of rows inside the read.

    All columns stay text so that the cleaning operators can count what fails.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)  # columns go by the header, a file with others is an error
        .csv(paths)
        .withColumn("source_file", F.col("_metadata.file_path"))
        .withColumn("ordinal", F.monotonically_increasing_id())
    )


def scan_panel(frames: Sequence[DataFrame]) -> DataFrame:
    """Union typed bar tables after an exact schema check."""
    panel = None
    for frame in frames:
        if set(frame.columns) != set(BAR_COLUMNS):
            raise ValueError(f"expected columns {BAR_COLUMNS}, found {frame.columns}")
        frame = frame.select(*BAR_COLUMNS)
        panel = frame if panel is None else panel.unionByName(frame)
    if panel is None:
        raise ValueError("no bar tables given")
    return panel


def read_market_snapshot(bars: DataFrame, required: Sequence[str]) -> DataFrame:
    """Normalise tickers and numbers of a panel; every required ticker must be present and complete."""
    missing = set(BAR_COLUMNS) - set(bars.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    panel = bars.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.to_date("date").alias("date"),
        *[F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double")).alias(c) for c in OHLCV],
    )
    incomplete = F.lit(False)
    for name in ["date", *OHLCV]:
        incomplete = incomplete | F.col(name).isNull()
    seen = panel.agg(
        F.collect_set("ticker").alias("tickers"), F.count_if(incomplete).alias("incomplete")
    ).first()
    absent = set(required) - set(seen["tickers"])
    if absent:
        raise ValueError(f"missing tickers {sorted(absent)}")
    if seen["incomplete"]:
        raise ValueError(f"{seen['incomplete']} rows with missing values")
    return panel


def packed_order(major: Column | str, minor: Column | str) -> Column:
    """One fixed-width DECIMAL(38) that sorts like (major, minor), both non-negative longs.

    A fixed-width key keeps min_by / max_by in hash aggregation; an ordering
    struct would force every input row through a sort.
    """

    def digits(value: Column | str) -> Column:
        column = F.col(value) if isinstance(value, str) else value
        return column.cast("long").cast("decimal(19,0)")

    return (digits(major) * F.lit(Decimal(10**18))).cast("decimal(38,0)") + digits(minor)


def hundredths(value: Column) -> Column:
    """Two-decimal amounts as exact whole hundredths; their sums do not depend on row order."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("long")


def trade_cells(
    trades: DataFrame,
    ticker: Column,
    date: Column,
    price: Column,
    quantity: Column,
    notional: Column,
    order: Column,
) -> DataFrame:
    """Mergeable state per (ticker, session): one hash aggregation with map-side partials.

    ``order`` is a total order of the trades as one fixed-width value.
    """
    rows = trades.select(
        ticker.alias("ticker"),
        date.alias("date"),
        price.alias("_price"),
        hundredths(quantity).alias("_quantity"),
        hundredths(notional).alias("_notional"),
        order.alias("_order"),
    )
    return rows.groupBy("ticker", "date").agg(
        F.min("_order").alias("first_order"),
        F.min_by("_price", "_order").alias("open"),
        F.max("_order").alias("last_order"),
        F.max_by("_price", "_order").alias("last_trade"),
        F.max("_price").alias("top"),
        F.min("_price").alias("bottom"),
        F.sum("_notional").alias("notional"),
        F.sum("_quantity").alias("quantity"),
        F.count(F.lit(1)).alias("trades"),
    )


def merge_cells(cells: DataFrame, ticker: Column) -> DataFrame:
    """Roll cells up to a coarser ticker, e.g. all tickers into one index."""
    return (
        cells.withColumn("ticker", ticker)
        .groupBy("ticker", "date")
        .agg(
            F.min_by("open", "first_order").alias("open"),
            F.min("first_order").alias("first_order"),
            F.max_by("last_trade", "last_order").alias("last_trade"),
            F.max("last_order").alias("last_order"),
            F.max("top").alias("top"),
            F.min("bottom").alias("bottom"),
            F.sum("notional").alias("notional"),
            F.sum("quantity").alias("quantity"),
            F.sum("trades").alias("trades"),
        )
    )


def bars_from_cells(cells: DataFrame, close: str = "vwap") -> DataFrame:
    """Daily candles; the close is the volume-weighted price or the last trade."""
    if close not in ("vwap", "last"):
        raise ValueError("close must be vwap or last")
    settled = (
        (F.col("notional") / F.lit(100.0)) / (F.col("quantity") / F.lit(100.0))
        if close == "vwap"
        else F.col("last_trade")
    )
    return cells.select(
        "ticker",
        "date",
        "open",
        F.greatest("top", settled).alias("high"),
        F.least("bottom", settled).alias("low"),
        settled.alias("close"),
        (F.col("quantity") / F.lit(100.0)).alias("volume"),
    )


def tick_bars(
    trades: DataFrame,
    ticker: Column,
    date: Column,
    price: Column,
    quantity: Column,
    order: Column,
    notional: Column | None = None,
    close: str = "last",
) -> DataFrame:
    """Daily candles per ticker from single trades."""
    notional = price * quantity if notional is None else notional
    return bars_from_cells(trade_cells(trades, ticker, date, price, quantity, notional, order), close)
