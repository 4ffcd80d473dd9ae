"""Window work on long series, split so that no task holds a whole series.

Two building blocks:

* calendar slices: ``slice_of(date)`` is known from the row alone, so rows of
  one series spread over many tasks; whatever a running computation needs from
  earlier slices is carried through one small summary row per slice.
* halo chunks: rows are numbered through the slice counts, cut into chunks of
  ``block`` sessions, and the ``lookback`` rows before a chunk are copied into it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

SLICE_DAYS = 1024


def slice_of(date: str | Column, days: int = SLICE_DAYS) -> Column:
    return F.floor(F.unix_date(date) / F.lit(days)).cast("long")


def number_sessions(
    df: DataFrame,
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
    days: int = SLICE_DAYS,
    name: str = "position",
) -> DataFrame:
    """Add the 0-based session position inside each series.

    Counts per slice are pre-aggregated, their prefix sums are the offsets, and
    only the rows of one slice are numbered together.
    """
    sliced = df.withColumn("_slice", slice_of(order, days))
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            "_slice",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order)) - 1
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_offset") + local)
        .drop("_slice", "_offset")
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 0-based place of a row among the rows of its keys in ``order``, whatever the columns.

    The rows are written in range partitions of keys and order; a partition numbers
    its own rows and one summary row per (keys, partition) carries what came before,
    so a key that holds any share of the rows is spread over many tasks.  Rows that
    tie get places in no stated order.
    """
    ranged = materialize(
        df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "numbered-rows"
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select(*keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        ranged.join(before, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.row_number().over(here) - 1)
        .drop("_part", "_before")
    )


def with_window_columns(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    lookback: int,
    lookahead: int = 0,
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
    block: int | None = None,
    days: int = SLICE_DAYS,
) -> DataFrame:
    """Add window columns that look at most ``lookback`` / ``lookahead`` rows away.

    ``build`` receives the ordered window and returns the columns.  Without
    ``block`` a series is one window partition (bounded by the calendar); with
    it the same expressions run on halo chunks of ``block`` sessions.  Chunks are
    spread by an explicit repartition: framed quantiles cost far more than their
    bytes suggest, so size-based coalescing would leave the work to one task.
    """
    if block is None:
        columns = build(Window.partitionBy(*keys).orderBy(order))
        return df.select("*", *[column.alias(name) for name, column in columns.items()])
    position = F.col("_position")
    spread = number_sessions(df, keys, order, days, "_position").withColumn(
        "_chunk",
        F.explode(
            F.sequence(
                F.floor(F.greatest(position - F.lit(lookahead), F.lit(0)) / F.lit(block)),
                F.floor((position + F.lit(lookback)) / F.lit(block)),
            )
        ),
    )
    columns = build(Window.partitionBy(*keys, "_chunk").orderBy(order))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        spread.repartition(partitions, *keys, "_chunk")
        .select("*", *[column.alias(name) for name, column in columns.items()])
        .filter(F.floor(position / F.lit(block)) == F.col("_chunk"))
        .drop("_position", "_chunk")
    )


def with_running_log_wealth(
    df: DataFrame,
    value: str = "ret",
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
    days: int = SLICE_DAYS,
) -> DataFrame:
    """Add ``log_wealth`` (running sum of log1p) and ``log_peak`` (its running maximum)."""
    inner = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = (
        df.withColumn("_slice", slice_of(order, days))
        .withColumn("_sum", F.sum(F.log1p(value)).over(inner))
        .withColumn("_top", F.max("_sum").over(inner))
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = (
        local.groupBy(*keys, "_slice")
        .agg(F.max("_top").alias("_slice_top"), F.max_by("_sum", order).alias("_slice_sum"))
        .withColumn("_before", F.coalesce(F.sum("_slice_sum").over(earlier), F.lit(0.0)))
        .withColumn("_peak_before", F.max(F.col("_before") + F.col("_slice_top")).over(earlier))
        .select(*keys, "_slice", "_before", "_peak_before")
    )
    return (
        local.join(tops, [*keys, "_slice"])
        .withColumn("log_wealth", F.col("_before") + F.col("_sum"))
        .withColumn(
            "log_peak",
            F.greatest(F.col("_before") + F.col("_top"), F.col("_peak_before")),
        )
        .drop("_slice", "_sum", "_top", "_before", "_peak_before")
    )


def decay_slice_days(decay: float, days: int = SLICE_DAYS) -> int:
    """Largest slice for which decay**-days stays far inside double range."""
    return max(1, min(days, int(600 / -math.log(decay))))


def with_ewma_variance(
    df: DataFrame,
    value: str = "ret",
    decay: float = 0.94,
    keys: Sequence[str] = ("series_id",),
    order: str = "date",
    days: int = SLICE_DAYS,
    prior: str = "variance_before",
    posterior: str = "variance_after",
) -> DataFrame:
    """Add the variance state before and after each return.

    v_1 = r_1**2 and v = decay * v + (1 - decay) * r**2.  The recursion is
    affine, so a slice is a weighted running sum plus ``carry * decay**(j+1)``,
    where the carry is the state at the end of the previous slice.
    """
    days = decay_slice_days(decay, days)
    lam = F.lit(decay)
    inner = Window.partitionBy(*keys, "_slice").orderBy(order)
    square = F.col(value) * F.col(value)
    local = (
        df.withColumn("_slice", slice_of(order, days))
        .withColumn("_j", (F.row_number().over(inner) - 1).cast("double"))
        .withColumn("_weighted", F.lit(1.0 - decay) * square * F.pow(lam, -F.col("_j")))
        .withColumn(
            "_local",
            F.pow(lam, F.col("_j"))
            * F.sum("_weighted").over(inner.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    along = Window.partitionBy(*keys).orderBy("_slice")
    summary = local.groupBy(*keys, "_slice").agg(
        F.max_by("_local", "_j").alias("a"),
        F.count(F.lit(1)).cast("double").alias("m"),
        F.min_by(square, F.col("_j")).alias("_first_square"),
    )
    states = (
        summary.withColumn("_seed", F.first("_first_square").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "_earlier",
            F.collect_list(F.struct("a", "m")).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .withColumn(
            "_carry",
            F.aggregate("_earlier", F.col("_seed"), lambda acc, s: acc * F.pow(lam, s["m"]) + s["a"]),
        )
        .withColumn("_opens", F.size("_earlier") == 0)
        .select(*keys, "_slice", "_carry", "_opens")
    )
    joined = local.join(states, [*keys, "_slice"]).withColumn(
        "_local_before", F.coalesce(F.lag("_local").over(inner), F.lit(0.0))
    )
    return (
        joined.withColumn(
            prior,
            F.when(
                ~(F.col("_opens") & (F.col("_j") == 0)),
                F.col("_local_before") + F.col("_carry") * F.pow(lam, F.col("_j")),
            ),
        )
        .withColumn(posterior, F.col("_local") + F.col("_carry") * F.pow(lam, F.col("_j") + 1))
        .drop("_slice", "_j", "_weighted", "_local", "_local_before", "_carry", "_opens")
    )
