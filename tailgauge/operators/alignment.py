"""Calendar alignment, validated joins and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLCV = ["open", "high", "low", "close", "volume"]


def align_calendars(bars: DataFrame, tickers: int | None = None) -> DataFrame:
    """Keep the sessions on which every ticker has a bar.

    Different tickers are counted by an aggregate that tasks combine first, so a
    session with very many bars is no large group and a repeated bar counts once.
    Without ``tickers`` their number is taken from the panel itself.
    """
    counted = bars.groupBy("date").agg(F.count_distinct("ticker").alias("_tickers"))
    if tickers is not None:
        whole = counted.filter(F.col("_tickers") == tickers)
    else:
        total = bars.agg(F.count_distinct("ticker").alias("_wanted"))
        whole = counted.join(total, F.col("_tickers") == F.col("_wanted"))
    return bars.join(whole.select("date"), "date", "left_semi")


def calendar_mismatch(bars: DataFrame, tickers: int) -> DataFrame:
    """Sessions that some tickers have and others miss."""
    return (
        bars.groupBy("date")
        .agg(F.count_distinct("ticker").alias("tickers"))
        .filter(F.col("tickers") != tickers)
    )


def calendar_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of common, left-only and right-only sessions of two calendars."""
    sides = (
        left.select("date", F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select("date", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy("date")
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    )
    return sides.agg(
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("common"),
        F.count_if(F.col("_r") == 0).alias("left_only"),
        F.count_if(F.col("_l") == 0).alias("right_only"),
        F.min(F.when(F.col("_r") == 0, F.col("date"))).alias("first_left_only"),
        F.min(F.when(F.col("_l") == 0, F.col("date"))).alias("first_right_only"),
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"{what}: key {list(keys)} is not unique")


def enrich_many_to_one(facts: DataFrame, dim: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Left join to a dimension with a unique key; a fact without a match is an error."""
    if check:
        require_unique(dim, keys, "dimension")
        if not facts.join(dim.select(*keys), list(keys), "left_anti").isEmpty():
            raise ValueError("rows without a match in the dimension")
    return facts.join(dim, list(keys), "left")


def merge_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """Inner join of two tables that are both unique on the key."""
    if check:
        require_unique(left, keys, "left side")
        require_unique(right, keys, "right side")
    return left.join(right, list(keys), "inner")


def reindex_left(calendar: DataFrame, market: DataFrame) -> DataFrame:
    """Market rows on a given calendar; sessions the market misses stay NULL."""
    return calendar.select("date").join(market, "date", "left")


def revised_rows(old: DataFrame, incoming: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Overlapping sessions whose stored value and new value disagree, one row per field."""
    overlap = old.select("ticker", "date", *[F.col(c).alias(f"{c}_old") for c in OHLCV]).join(
        incoming.select("ticker", "date", *[F.col(c).alias(f"{c}_new") for c in OHLCV]), ["ticker", "date"]
    )
    fields = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"{c}_old").alias("old"), F.col(f"{c}_new").alias("new"))
            for c in OHLCV
        ]
    )
    return (
        overlap.select("ticker", "date", F.inline(fields))
        .filter(F.abs(F.col("old") - F.col("new")) > F.lit(tolerance) + F.lit(tolerance) * F.abs("new"))
    )


def new_sessions(old: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.join(old.select("ticker", "date"), ["ticker", "date"], "left_anti")


def merge_history(old: DataFrame, incoming: DataFrame, tolerance: float = 1e-8, check: bool = True) -> DataFrame:
    """Append new sessions; a silent revision of a stored bar is an error."""
    if check:
        revised = revised_rows(old, incoming, tolerance).select("ticker", "field").limit(1).collect()
        if revised:
            raise ValueError(f"{revised[0]['ticker']}: provider revised historical {revised[0]['field']}")
    return old.unionByName(new_sessions(old, incoming).select(*old.columns))


def previous_session(targets: DataFrame, calendar: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Strict as-of: the greatest calendar date before each target.

    Targets need not be calendar sessions: both sides are merged into one
    ordered stream per key and the last calendar date before a row is taken.
    """
    marked = calendar.select(*keys, "date", F.lit(None).cast("date").alias("target_date")).unionByName(
        targets.select(*keys, F.lit(None).cast("date").alias("date"), "target_date").distinct()
    )
    w = (
        Window.partitionBy(*keys)
        .orderBy(F.unix_date(F.coalesce("date", "target_date")))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    origins = (
        marked.withColumn("as_of", F.max("date").over(w))
        .filter(F.col("target_date").isNotNull())
        .select(*keys, "target_date", "as_of")
    )
    return targets.join(origins, [*keys, "target_date"], "left")


def previous_session_on_calendar(calendar: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The same for targets that are calendar sessions: a plain lag."""
    w = Window.partitionBy(*keys).orderBy("date")
    return calendar.select(*keys, F.col("date").alias("target_date"), F.lag("date").over(w).alias("as_of"))


def training_rows(features: DataFrame, tasks: int, first_task_position: int, step: int, rolling: int | None = None,
                  position: str = "position") -> DataFrame:
    """Rows each refit may learn from, as (task, row) pairs.

    Task k predicts from session ``first_task_position + k * step`` on and
    learns from earlier sessions: all of them, or the last ``rolling`` ones.
    The tasks a row belongs to are a range known from its position, so the pairs
    come from one explode instead of a range join.
    """
    pos = F.col(position)
    first = F.greatest(F.floor((pos - F.lit(first_task_position)) / F.lit(step)) + 1, F.lit(0)).cast("int")
    last = F.lit(tasks - 1)
    if rolling is not None:
        last = F.least(
            last, F.floor((pos + F.lit(rolling) - F.lit(first_task_position)) / F.lit(step)).cast("int")
        )
    return (
        features.withColumn("_first", first)
        .withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("task", F.explode(F.sequence("_first", "_last")))
        .drop("_first", "_last")
    )


def pair_methods(predictions: DataFrame, left: str, right: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per target with both methods side by side, in one aggregation."""
    wanted = predictions.filter(F.col("method").isin(left, right))

    def side(name: str, method: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(name)))

    fields = ["as_of", "actual_return", "quantile_return", "var", "violation"]
    return wanted.groupBy(*keys, "target_date").agg(
        *[side(f, left).alias(f"left_{f}") for f in fields],
        *[side(f, right).alias(f"right_{f}") for f in fields],
    )


def unpaired_targets(paired: DataFrame, tolerance: float = 1e-13) -> DataFrame:
    """Targets on which two methods are not comparable."""
    return paired.filter(
        F.col("left_as_of").isNull()
        | F.col("right_as_of").isNull()
        | (F.col("left_as_of") != F.col("right_as_of"))
        | (F.abs(F.col("left_actual_return") - F.col("right_actual_return")) > tolerance)
    )


def restrict_common_dates(
    predictions: DataFrame, variant: str = "method", keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Keep the targets every variant of a series forecasts (semi join)."""
    variants = predictions.select(*keys, variant).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_wanted"))
    per_date = predictions.groupBy(*keys, "target_date").agg(F.count_distinct(variant).alias("_found"))
    common = per_date.join(variants, list(keys)).filter(F.col("_found") == F.col("_wanted"))
    return predictions.join(common.select(*keys, "target_date"), [*keys, "target_date"], "left_semi")


def compare_reference(
    observed: DataFrame,
    reference: DataFrame,
    keys: Sequence[str],
    value: str,
    group: Sequence[str],
    tolerance: float = 1e-9,
) -> DataFrame:
    """Max / mean absolute difference per group; an unmatched key is a mismatch."""
    joined = observed.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(
        reference.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), list(keys), "full_outer"
    )
    difference = F.abs(F.col("_a") - F.col("_b"))
    unmatched = F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull())
    return joined.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        unmatched.alias("unmatched"),
        F.max(difference).alias("max_abs_difference"),
        F.avg(difference).alias("mean_abs_difference"),
    ).withColumn(
        "status",
        F.when((F.col("unmatched") == 0) & (F.col("max_abs_difference") <= tolerance), "PASS").otherwise("MISMATCH"),
    )


def reconcile_metrics(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    exact: Sequence[str],
    approximate: Sequence[str],
    tolerance: float = 1e-12,
) -> DataFrame:
    """Field-by-field differences of two metric tables; counts must agree exactly."""
    fields = [*exact, *approximate]
    joined = left.select(*keys, *[F.col(f).alias(f"{f}_l") for f in fields], F.lit(1).alias("_l")).join(
        right.select(*keys, *[F.col(f).alias(f"{f}_r") for f in fields], F.lit(1).alias("_r")),
        list(keys),
        "full_outer",
    )
    side = (
        F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    )
    errors = F.when(side == "both", F.lit(0)).otherwise(F.lit(1))
    columns = []
    for field in fields:
        difference = F.abs(F.col(f"{field}_l").cast("double") - F.col(f"{field}_r").cast("double"))
        limit = 0.0 if field in exact else tolerance
        columns.append(difference.alias(f"{field}_abs_difference"))
        errors = errors + F.when(difference <= limit, 0).otherwise(1)
    return joined.select(
        *keys, side.alias("side"), *columns, errors.cast("long").alias("errors"),
        F.when(errors == 0, "PASS").otherwise("FAIL").alias("status"),
    )


def join_feature_sets(returns: DataFrame, market: DataFrame, target: DataFrame,
                      keys: Sequence[str] = ("series_id", "target_date")) -> DataFrame:
    """Inner joins on the target, then only rows without a missing value."""
    shared = [k for k in keys if k in market.columns]
    return returns.join(market, shared, "inner").join(target, list(keys), "inner").dropna()
