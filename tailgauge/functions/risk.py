"""Scalar column expressions of quantile forecasts and coverage tests."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = 0.05

# Lower-tail standard normal quantiles used by the normal forecaster.
NORMAL_QUANTILES = {0.01: -2.3263478740408408, 0.05: -1.6448536269514726, 0.10: -1.2815515655446004}


def normal_quantile(alpha: float) -> float:
    if alpha in NORMAL_QUANTILES:
        return NORMAL_QUANTILES[alpha]
    from statistics import NormalDist

    return NormalDist().inv_cdf(alpha)


def known(value: Column) -> Column:
    """NaN is missing: turn it into NULL."""
    return F.nanvl(value, F.lit(None).cast("double"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def var_from_quantile(quantile: Column) -> Column:
    return F.greatest(F.lit(0.0), -quantile)


def is_violation(actual: Column, quantile: Column) -> Column:
    """Strictly below the forecast; equality is no violation."""
    return actual < quantile


def pinball(actual: Column, quantile: Column, alpha: float = ALPHA) -> Column:
    error = actual - quantile
    return F.greatest(F.lit(alpha) * error, F.lit(alpha - 1.0) * error)


def x_log_p(count: Column, probability: Column) -> Column:
    """count * ln(probability) with 0 * ln 0 = 0."""
    return F.when(count == 0, F.lit(0.0)).otherwise(count * F.ln(probability))


def binomial_loglik(hits: Column, total: Column, probability: Column) -> Column:
    return x_log_p(hits, probability) + x_log_p(total - hits, F.lit(1.0) - probability)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, inside the JVM.

    Power series below 2, continued fraction from 2 on; both are folds over a
    constant sequence, so they stay plain Spark expressions.
    """
    square = x * x
    start = F.struct(x.alias("term"), x.alias("total"))

    def grow(state: Column, n: Column) -> Column:
        term = state["term"] * F.lit(2.0) * square / (F.lit(2.0) * n + F.lit(3.0))
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(0), F.lit(79)), start, grow, lambda s: s["total"])
    small = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-square) * series
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), x, lambda acc, k: x + (k / F.lit(2.0)) / acc)
    large = F.exp(-square) / (F.lit(math.sqrt(math.pi)) * fraction)
    return F.when(x < 2.0, small).otherwise(large)


def chi_square_tail(statistic: Column) -> Column:
    """Survival function of the chi-square distribution with one degree of freedom."""
    return erfc(F.sqrt(statistic / F.lit(2.0)))
