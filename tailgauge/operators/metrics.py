"""Scores and metric tables of quantile forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ALPHA, is_violation, pinball, var_from_quantile
from .alignment import pair_methods

GROUP = ("series_id", "method")


def score_predictions(predictions: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """VaR, strict violation and pinball loss of every row, from actual and quantile only."""
    actual, quantile = F.col("actual_return"), F.col("quantile_return")
    return predictions.withColumns(
        {
            "var": var_from_quantile(quantile),
            "violation": is_violation(actual, quantile),
            "pinball_loss": pinball(actual, quantile, alpha),
        }
    )


def loss(alpha: float = ALPHA) -> Column:
    return pinball(F.col("actual_return"), F.col("quantile_return"), alpha)


def hit() -> Column:
    return is_violation(F.col("actual_return"), F.col("quantile_return"))


def summary_columns(alpha: float = ALPHA) -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("n_targets"),
        F.count_if(hit()).alias("n_violations"),
        (F.count_if(hit()) / n).alias("violation_rate"),
        F.avg(loss(alpha)).alias("mean_pinball_loss"),
        F.avg(var_from_quantile(F.col("quantile_return"))).alias("average_var"),
    ]


def violation_metrics(predictions: DataFrame, group: Sequence[str] = GROUP, alpha: float = ALPHA) -> DataFrame:
    return predictions.groupBy(*group).agg(*summary_columns(alpha))


def fold_metrics(predictions: DataFrame, alpha: float = ALPHA, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows per (model, fold) and the all_validation subtotal, from one pass of grouping sets."""
    sets = [
        [F.col(k) for k in [*keys, "model", "fold"]],
        [F.col(k) for k in [*keys, "model"]],
    ]
    return predictions.groupingSets(sets, *[F.col(k) for k in [*keys, "model", "fold"]]).agg(
        F.grouping("fold").alias("_total"),
        F.min("target_date").alias("first_target"),
        F.max("target_date").alias("last_target"),
        *summary_columns(alpha),
    ).select(
        *keys,
        "model",
        F.when(F.col("_total") == 1, "all_validation").otherwise(F.col("fold").cast("string")).alias("fold"),
        "first_target", "last_target", "n_targets", "n_violations", "violation_rate", "mean_pinball_loss",
        "average_var",
    )


def fold_totals_disagree(metrics: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Models whose fold violations do not add up to the subtotal."""
    total = F.col("fold") == "all_validation"
    return (
        metrics.groupBy(*keys, "model")
        .agg(
            F.sum(F.when(~total, F.col("n_violations")).otherwise(0)).alias("of_folds"),
            F.sum(F.when(total, F.col("n_violations")).otherwise(0)).alias("of_all"),
        )
        .filter(F.col("of_folds") != F.col("of_all"))
    )


def final_metrics(predictions: DataFrame, runs: DataFrame, alpha: float = ALPHA,
                  group: Sequence[str] = GROUP) -> DataFrame:
    """Twelve-column row per method; ``runs`` gives runtime and configuration per method."""
    measured = predictions.groupBy(*group).agg(
        F.count(F.lit(1)).alias("forecast_count"),
        F.count_if("violation").alias("violation_count"),
        (F.count_if("violation") / F.count(F.lit(1))).alias("violation_rate"),
        F.avg(loss(alpha)).alias("pinball_loss"),
        F.avg("var").alias("average_var"),
        F.min("var").alias("minimum_var"),
        F.max("var").alias("maximum_var"),
        F.min("target_date").alias("test_start"),
        F.max("target_date").alias("test_end"),
    )
    return measured.join(runs, "method", "left").select(
        *group, "forecast_count", "violation_count", "violation_rate", "pinball_loss", "average_var", "minimum_var",
        "maximum_var", "total_runtime_seconds", "test_start", "test_end", "config_id",
    )


def criterion_leaders(metrics: DataFrame, alpha: float = ALPHA, tolerance: float = 1e-15,
                      per: Sequence[str] = ("series_id",)) -> DataFrame:
    """Leader flag per criterion; ties lead together and no overall winner is named."""
    distance = F.abs(F.col("violation_rate") - alpha)
    among = Window.partitionBy(*per)

    def leads(value: Column) -> Column:
        return F.abs(value - F.min(value).over(among)) <= tolerance

    return metrics.withColumn("calibration_distance", distance).select(
        *per,
        "method",
        "violation_rate",
        "calibration_distance",
        "pinball_loss",
        "average_var",
        leads(F.col("calibration_distance")).alias("calibration_leader"),
        leads(F.col("pinball_loss")).alias("pinball_leader"),
        leads(F.col("average_var")).alias("lowest_average_var"),
    )


def model_comparison(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "series_id", "method", "forecast_count", "violation_count", "violation_rate", "pinball_loss", "average_var"
    ).orderBy("series_id", "method")


def exception_table(predictions: DataFrame) -> DataFrame:
    return (
        predictions.filter("violation")
        .select("series_id", "target_date", "method", "actual_return", "quantile_return", "var")
        .orderBy("target_date", "method", "series_id")
    )


def latest_var(predictions: DataFrame) -> DataFrame:
    """Last row per method, by aggregation (no per-group sort)."""
    columns = ["target_date", "actual_return", "quantile_return", "var", "violation"]
    return predictions.groupBy(*GROUP).agg(
        F.max("target_date").alias("target_date"),
        *[F.max_by(c, "target_date").alias(c) for c in columns[1:]],
    )


def report_summary(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "series_id",
        "method",
        "forecast_count",
        F.format_string("%.2f%%", F.col("violation_rate") * 100.0).alias("violation_rate_text"),
    )


def cv_aggregate(folds: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Sum of targets and violations, mean of the fold losses, pooled rate."""
    return (
        folds.filter(F.col("fold") != "all_validation")
        .groupBy(*keys, "model")
        .agg(
            F.sum("n_targets").alias("n_targets"),
            F.sum("n_violations").alias("n_violations"),
            F.avg("mean_pinball_loss").alias("mean_pinball_loss"),
        )
        .withColumn("violation_rate", F.col("n_violations") / F.col("n_targets"))
    )


def forecast_sanity(predictions: DataFrame) -> DataFrame:
    """Location of the quantile forecasts and the count beyond three interquartile ranges."""
    stats = predictions.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.count_if("violation").alias("violation_count"),
        F.min("quantile_return").alias("quantile_min"),
        F.max("quantile_return").alias("quantile_max"),
        F.avg("quantile_return").alias("quantile_mean"),
        F.percentile("quantile_return", F.lit([0.05, 0.25, 0.5, 0.75, 0.95])).alias("_p"),
        F.min("var").alias("var_min"),
        F.max("var").alias("var_max"),
    )
    spread = F.col("_p")[3] - F.col("_p")[1]
    fences = stats.select(
        *GROUP, (F.col("_p")[1] - 3 * spread).alias("_low"), (F.col("_p")[3] + 3 * spread).alias("_high")
    )
    beyond = (
        predictions.join(fences, list(GROUP))
        .groupBy(*GROUP)
        .agg(
            F.count_if((F.col("quantile_return") < F.col("_low")) | (F.col("quantile_return") > F.col("_high"))).alias(
                "outlier_count"
            )
        )
    )
    return stats.join(beyond, list(GROUP)).select(
        *GROUP, "prediction_count", "violation_count", "quantile_min", "quantile_max", "quantile_mean",
        F.col("_p")[2].alias("quantile_median"), F.col("_p")[0].alias("quantile_p05"),
        F.col("_p")[4].alias("quantile_p95"), "var_min", "var_max", "outlier_count",
    )


def var_level_summary(predictions: DataFrame) -> DataFrame:
    """Level statistics of the VaR and the sessions of its extremes (earliest on ties)."""
    latest_first = F.struct(F.col("var"), -F.unix_date("target_date"))
    return predictions.groupBy(*GROUP).agg(
        F.avg("var").alias("mean_var"),
        F.percentile("var", F.lit(0.5)).alias("median_var"),
        F.stddev_samp("var").alias("std_var"),
        F.percentile("var", F.lit(0.25)).alias("q25_var"),
        F.percentile("var", F.lit(0.75)).alias("q75_var"),
        F.min("var").alias("min_var"),
        F.max("var").alias("max_var"),
        F.min_by("target_date", F.struct("var", "target_date")).alias("min_var_date"),
        F.max_by("target_date", latest_first).alias("max_var_date"),
    )


def var_neighborhood(predictions: DataFrame, radius: int = 5) -> DataFrame:
    """Rows within ``radius`` sessions of each method's smallest and largest VaR (earliest on ties).

    The change starts inside the neighborhood: its first row has none.
    """
    w = Window.partitionBy(*GROUP).orderBy("target_date")
    rows = predictions.withColumn("position", F.row_number().over(w) - 1).withColumn(
        "_change", F.col("var") - F.lag("var").over(w)
    )
    centers = rows.groupBy(*GROUP).agg(
        F.min_by("position", F.struct("var", "position")).alias("_low"),
        F.max_by("position", F.struct(F.col("var"), -F.col("position"))).alias("_high"),
    )
    extremes = F.array(
        F.struct(F.lit("minimum").alias("extreme"), F.col("_low").alias("_center")),
        F.struct(F.lit("maximum").alias("extreme"), F.col("_high").alias("_center")),
    )
    offset = F.col("position") - F.col("_center")
    first = F.greatest(F.col("_center") - radius, F.lit(0))
    return (
        rows.join(centers.select(*GROUP, F.inline(extremes)), list(GROUP))
        .filter(F.abs(offset) <= radius)
        .select(
            *GROUP,
            "extreme",
            "target_date",
            offset.cast("long").alias("offset"),
            "var",
            F.when(F.col("position") > first, F.col("_change")).alias("var_change"),
            "actual_return",
        )
    )


def paired_loss_comparison(predictions: DataFrame, base: str, candidate: str, alpha: float = ALPHA) -> DataFrame:
    paired = pair_methods(predictions, base, candidate).filter(
        F.col("left_quantile_return").isNotNull() & F.col("right_quantile_return").isNotNull()
    )
    left = pinball(F.col("left_actual_return"), F.col("left_quantile_return"), alpha)
    right = pinball(F.col("right_actual_return"), F.col("right_quantile_return"), alpha)
    return paired.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_common"),
        F.avg(left).alias("baseline_loss"),
        F.avg(right).alias("candidate_loss"),
        F.count_if("left_violation").alias("baseline_violations"),
        F.count_if("right_violation").alias("candidate_violations"),
    ).withColumns(
        {
            "paired_loss_improvement": F.col("baseline_loss") - F.col("candidate_loss"),
            "relative_loss_improvement_pct": F.lit(100.0)
            * (F.col("baseline_loss") - F.col("candidate_loss"))
            / F.col("baseline_loss"),
        }
    )
