"""Time-ordered folds, development / holdout split and rankings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocked import number_sessions


def expanding_folds(features: DataFrame, k: int = 5, key: str = "series_id", order: str = "target_date") -> DataFrame:
    """Add ``fold``: 0 for the first training block, 1..k for the validation blocks.

    The block width is n // (k + 1); the remainder stays in the first block.
    Fold f is validated on block f and trained on all blocks before it.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    sizes = features.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    width = F.floor(F.col("_n") / F.lit(k + 1))
    first = F.col("_n") - F.lit(k) * width
    return (
        number_sessions(features, (key,), order)
        .join(sizes, key)
        .withColumn(
            "fold",
            F.when(F.col("position") < first, F.lit(0))
            .otherwise(F.floor(F.try_divide(F.col("position") - first, width)) + 1)
            .cast("int"),
        )
        .drop("_n")
    )


def fold_training_rows(folded: DataFrame, k: int = 5) -> DataFrame:
    """(fold, row) pairs of the expanding training sets; a row of block b trains folds b+1..k."""
    return (
        folded.withColumnRenamed("fold", "_block")
        .filter(F.col("_block") < k)
        .withColumn("fold", F.explode(F.sequence(F.col("_block") + 1, F.lit(k))))
        .drop("_block")
    )


def fold_plan(folded: DataFrame, k: int = 5, key: str = "series_id", order: str = "target_date") -> DataFrame:
    """One row per fold: training and validation sizes and boundaries."""
    train = fold_training_rows(folded, k).groupBy(key, "fold").agg(
        F.count(F.lit(1)).alias("train_rows"), F.min(order).alias("train_start"), F.max(order).alias("train_end")
    )
    valid = folded.filter(F.col("fold") > 0).groupBy(key, "fold").agg(
        F.count(F.lit(1)).alias("valid_rows"), F.min(order).alias("valid_start"), F.max(order).alias("valid_end")
    )
    return train.join(valid, [key, "fold"])


def dev_holdout_split(features: DataFrame, development_end: date, order: str = "target_date") -> DataFrame:
    """Label rows ``development`` or ``holdout`` by date; the two never overlap."""
    return features.withColumn(
        "part", F.when(F.col(order) <= F.lit(development_end), "development").otherwise("holdout")
    )


def require_split_sizes(split: DataFrame, minimum: int, key: str = "series_id") -> None:
    small = (
        split.groupBy(key)
        .agg(
            F.count_if(F.col("part") == "development").alias("development"),
            F.count_if(F.col("part") == "holdout").alias("holdout"),
        )
        .filter((F.col("development") < minimum) | (F.col("holdout") < minimum))
    )
    if not small.isEmpty():
        raise ValueError(f"development or holdout smaller than {minimum} rows")


def cv_ranking(metrics: DataFrame, prefix: str | None = None, loss: str = "mean_pinball_loss",
               key: str = "series_id") -> DataFrame:
    """Mean fold loss per series and model, ranked in each series; ties keep name order.

    ``prefix`` picks the best candidate of each series among the models whose names
    begin with it, as one aggregate.
    """
    means = metrics.groupBy(key, "model").agg(F.avg(loss).alias("cv_mean_loss"), F.count(F.lit(1)).alias("folds"))
    if prefix is not None:
        best = F.min(F.struct("cv_mean_loss", "model", "folds")).alias("best")
        return means.filter(F.col("model").startswith(prefix)).groupBy(key).agg(best).select(key, "best.*")
    ranking = Window.partitionBy(key).orderBy("cv_mean_loss", "model")
    return means.withColumn("rank", F.row_number().over(ranking).cast("long"))
