"""Exact order statistics of groups of any size, without holding a group anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def order_statistics(df: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str, bins: int = 1024,
                     small: int = 4096) -> DataFrame:
    """Add ``selected`` to ``ranks`` (keys and 1-based ``rank``): the value of that rank in its group of ``df``.

    Each pass counts the values between two bounds in equal bins and narrows the
    bounds to the bin that holds the rank, so what is shuffled is bins, not values.
    A rank is found when its bounds meet (a value that repeats any number of times)
    or at most ``small`` values are left, which are then ranked.  Values must be
    finite; a rank outside its group gives NULL; ties do not matter.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    columns = [*keys, "rank", "_k", "_lo", "_hi", "_n"]
    bounds = materialize(
        ranks.join(span, keys).filter((F.col("rank") >= 1) & (F.col("rank") <= F.col("_n"))).withColumn("_k", F.col("rank")).select(*columns),
        "selection",
    )
    wide = (F.col("_n") > small) & (F.col("_lo") < F.col("_hi"))
    while not bounds.filter(wide).isEmpty():
        inside = df.select(*keys, F.col(value).alias("_v")).join(bounds.filter(wide), keys).filter("_v BETWEEN _lo AND _hi")
        place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        counted = inside.groupBy(*keys, "rank", "_k", place.alias("_bin")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = F.sum("_c").over(Window.partitionBy(*keys, "rank").orderBy("_bin"))
        narrowed = (
            counted.withColumn("_upto", upto)
            .filter("_upto >= _k AND _upto - _c < _k")
            .select(*keys, "rank", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"), F.col("_low").alias("_lo"),
                    F.col("_high").alias("_hi"), F.col("_c").alias("_n"))
        )
        bounds = materialize(bounds.filter(~wide).select(*columns).unionByName(narrowed), "selection")
    met = bounds.filter("_lo = _hi").select(*keys, "rank", F.col("_lo").alias("selected"))
    few = df.select(*keys, F.col(value).alias("_v")).join(bounds.filter("_lo < _hi"), keys).filter("_v BETWEEN _lo AND _hi")
    ranked = few.groupBy(*keys, "rank").agg(
        F.element_at(F.sort_array(F.collect_list("_v")), F.first("_k").cast("int")).alias("selected")
    )
    return ranks.join(met.unionByName(ranked), [*keys, "rank"], "left")


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, alpha: float, bins: int = 1024,
                    small: int = 4096) -> DataFrame:
    """Linearly interpolated quantile of every group as ``quantile``, by exact selection of its two neighbours."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("_rows")).filter("_rows > 0")
    at = F.lit(alpha) * (F.col("_rows") - 1)
    low = F.floor(at)
    spots = sizes.select(
        *keys, (at - low).alias("_part"),
        F.explode(F.array_distinct(F.array(low + 1, F.least(low + 2, F.col("_rows"))))).alias("rank"),
    )
    found = order_statistics(df, spots.select(*keys, "rank"), keys, value, bins, small)
    return (
        found.join(spots, [*keys, "rank"])
        .groupBy(*keys)
        .agg(F.min("selected").alias("_a"), F.max("selected").alias("_b"), F.first("_part").alias("_part"))
        .select(*keys, (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("quantile"))
    )
