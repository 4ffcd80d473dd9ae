"""Contracts of prediction and metric tables: one aggregate, one count per rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ALPHA, finite, is_violation, var_from_quantile
from .alignment import reconcile_metrics
from .metrics import GROUP, hit, loss


def _broken(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(True))).alias(name)


def prediction_violations(predictions: DataFrame, tolerance: float = 1e-15,
                          keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Violations per rule: row rules, key uniqueness, equal target universe and equal actuals.

    Rows meet once, on (series, target date): copies, missing methods and
    differing actual returns all show in that aggregation.
    """
    bad_number = ~finite(F.col("actual_return")) | ~finite(F.col("quantile_return")) | ~finite(F.col("var"))
    off = F.abs(F.col("var") - var_from_quantile(F.col("quantile_return"))) > tolerance
    rule = F.col("violation") != is_violation(F.col("actual_return"), F.col("quantile_return"))
    per_method = predictions.groupBy(*keys, "target_date", "method").agg(
        F.count(F.lit(1)).alias("_rows"),
        _broken(bad_number, "not_finite"),
        _broken(F.col("as_of") >= F.col("target_date"), "origin_not_before_target"),
        _broken(off, "var_sign_or_value"),
        _broken(rule, "violation_rule"),
        _broken(F.col("actual_return") <= -1.0, "return_domain"),
        F.min("actual_return").alias("_low"),
        F.max("actual_return").alias("_high"),
    )
    row_rules = ["not_finite", "origin_not_before_target", "var_sign_or_value", "violation_rule", "return_domain"]
    per_target = per_method.groupBy(*keys, "target_date").agg(
        F.count(F.lit(1)).alias("_methods"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_keys"),
        F.sum("_rows").alias("rows"),
        *[F.sum(c).alias(c) for c in row_rules],
        (F.max("_high") - F.min("_low")).alias("_actual_spread"),
    )
    per_series = predictions.select(*keys, "method").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_wanted")
    )
    return (
        per_target.join(per_series, list(keys))
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("duplicate_keys").alias("duplicate_keys"),
            *[F.sum(c).alias(c) for c in row_rules],
            F.count_if(F.col("_methods") != F.col("_wanted")).alias("unequal_universe"),
            F.count_if(F.col("_actual_spread") > 1e-15).alias("unequal_actuals"),
        )
    )


PREDICTION_RULES = [
    "duplicate_keys", "not_finite", "origin_not_before_target", "var_sign_or_value", "violation_rule",
    "return_domain", "unequal_universe", "unequal_actuals",
]


def _raise_on(counts: DataFrame, rules: Sequence[str], what: str) -> None:
    broken = F.lit(False)
    for rule in rules:
        broken = broken | (F.col(rule) > 0)
    rows = counts.filter(broken).limit(1).collect()
    if rows:
        found = {rule: rows[0][rule] for rule in rules if rows[0][rule]}
        raise ValueError(f"{what} break the contract: {found}")


def validate_predictions(predictions: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """Return the table unchanged or raise with the violated rules."""
    required = {"series_id", "method", "as_of", "target_date", "actual_return", "quantile_return", "var", "violation"}
    missing = required - set(predictions.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    _raise_on(prediction_violations(predictions, tolerance), PREDICTION_RULES, "predictions")
    return predictions


METRIC_RULES = ["duplicate_methods", "bad_counts", "rate_mismatch", "var_range", "not_finite"]


def metric_violations(metrics: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    n, x = F.col("forecast_count"), F.col("violation_count")
    numbers = ["violation_rate", "pinball_loss", "average_var", "minimum_var", "maximum_var"]
    bad_number = F.lit(False)
    for name in numbers:
        bad_number = bad_number | ~finite(F.col(name))
    ordered = (
        (F.col("minimum_var") <= F.col("average_var") + tolerance)
        & (F.col("average_var") <= F.col("maximum_var") + tolerance)
        & (F.col("minimum_var") >= 0)
    )
    per_method = metrics.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("_rows"),
        _broken((n <= 0) | (x < 0) | (x > n), "bad_counts"),
        _broken(F.abs(F.col("violation_rate") - F.try_divide(x, n)) > tolerance, "rate_mismatch"),
        _broken(~ordered, "var_range"),
        _broken(bad_number, "not_finite"),
    )
    return per_method.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("methods"),
        F.count_if(F.col("_rows") > 1).alias("duplicate_methods"),
        *[F.sum(c).alias(c) for c in METRIC_RULES[1:]],
    )


def validate_metrics(metrics: DataFrame) -> DataFrame:
    _raise_on(metric_violations(metrics), METRIC_RULES, "metrics")
    return metrics


def audit_metrics(predictions: DataFrame, reported: DataFrame, alpha: float = ALPHA,
                  tolerance: float = 1e-12) -> DataFrame:
    """Recompute the metrics from the rows and compare with the reported table."""
    again = predictions.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("forecast_count"),
        F.count_if(hit()).alias("violation_count"),
        (F.count_if(hit()) / F.count(F.lit(1))).alias("violation_rate"),
        F.avg(loss(alpha)).alias("pinball_loss"),
        F.avg(var_from_quantile(F.col("quantile_return"))).alias("average_var"),
    )
    return reconcile_metrics(
        again, reported, GROUP, ["forecast_count", "violation_count"],
        ["violation_rate", "pinball_loss", "average_var"], tolerance,
    )


def normalize_predictions(raw: DataFrame, source: str, protocol: str) -> DataFrame:
    """Bring foreign prediction rows into the common form, tagged and with the violation recomputed."""
    if not source.strip() or not protocol.strip():
        raise ValueError("source and protocol must not be empty")
    label = F.trim(F.col("model"))
    when = F.when(F.date_format("target_date", "HH:mm:ss") == "00:00:00", F.to_date("target_date"))
    return raw.select(
        "series_id",
        F.when(label != "", label).alias("model"),
        F.col("fold").cast("string").alias("fold"),
        F.to_date("as_of").alias("as_of"),
        when.alias("target_date"),
        F.col("actual_return").cast("double").alias("actual_return"),
        F.col("quantile_return").cast("double").alias("quantile_return"),
        var_from_quantile(F.col("quantile_return").cast("double")).alias("var_return"),
        is_violation(F.col("actual_return").cast("double"), F.col("quantile_return").cast("double")).alias("violation"),
        F.lit(source.strip()).alias("source"),
        F.lit(protocol.strip()).alias("protocol"),
    )
