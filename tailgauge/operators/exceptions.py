"""VaR exceptions: matrices, clusters, severity and case selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_id"
# Column prefix of each method.
METHOD_PREFIX: Mapping[str, str] = {
    "historical_simulation": "historical",
    "ewma": "ewma",
    "gradient_boosting": "gb",
}


def _of(method: str, value: Column) -> Column:
    return F.max(F.when(F.col("method") == method, value))


def flag(prefix: str) -> Column:
    return F.col(f"{prefix}_violation").cast("int")


def classify_exception(prefixes: Sequence[str] = ("historical", "ewma", "gb")) -> Column:
    """Category of a session from the method flags."""
    count = sum((flag(p) for p in prefixes[1:]), flag(prefixes[0]))
    category = F.when(count == 0, "no_violation")
    if len(prefixes) == 2:
        category = F.when(count == 0, "none").when(count == 2, "both")
    else:
        category = category.when(count == 3, "shared_all_3").when(count == 2, "shared_exactly_2")
    for prefix in prefixes:
        category = category.when(flag(prefix) == 1, f"{prefix}_only")
    return category


def exception_matrix(predictions: DataFrame, methods: Mapping[str, str] = METHOD_PREFIX) -> DataFrame:
    """One row per session with the flag of every method, by conditional aggregation."""
    flags = [_of(m, F.col("violation")).alias(f"{p}_violation") for m, p in methods.items()]
    prefixes = list(methods.values())
    wide = predictions.groupBy(KEY, "target_date").agg(*flags, F.max("actual_return").alias("actual_return"))
    count = sum((flag(p) for p in prefixes[1:]), flag(prefixes[0]))
    return wide.withColumns(
        {
            "violation_method_count": count.cast("long"),
            "exception_category": classify_exception(prefixes),
            "calendar_month": F.date_format("target_date", "yyyy-MM"),
        }
    )


def near_clusters(matrix: DataFrame, gap: int = 2) -> DataFrame:
    """Number exception clusters: sessions at most ``gap`` positions apart belong together."""
    w = Window.partitionBy(KEY).orderBy("target_date")
    placed = matrix.withColumn("target_position", (F.row_number().over(w) - 1).cast("long"))
    jump = F.col("target_position") - F.lag("target_position").over(w)
    opens = F.when(jump.isNull() | (jump > gap), 1).otherwise(0)
    return (
        placed.filter(F.col("violation_method_count") > 0)
        .withColumn("_opens", opens)
        .withColumn(
            "cluster_id", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
        )
        .drop("_opens")
    )


def strict_clusters(predictions: DataFrame) -> DataFrame:
    """Runs of adjacent exceptions per method."""
    w = Window.partitionBy(KEY, "method").orderBy("target_date")
    placed = predictions.withColumn("_position", F.row_number().over(w))
    runs = placed.filter("violation").withColumn("_run", F.col("_position") - F.row_number().over(w))
    return runs.groupBy(KEY, "method", "_run").agg(
        F.min("target_date").alias("cluster_start"),
        F.max("target_date").alias("cluster_end"),
        F.count(F.lit(1)).alias("length"),
        F.max(F.col("quantile_return") - F.col("actual_return")).alias("max_exceedance"),
    ).drop("_run")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(KEY, "method").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(F.col("length") == 1).alias("singletons"),
        F.count_if(F.col("length") > 1).alias("multi_observation"),
        F.max("length").alias("max_length"),
        F.sum("length").alias("exceptions"),
    )


def cluster_length_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(KEY, "method", "length").agg(F.count(F.lit(1)).alias("clusters"))


def largest_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    """Longest clusters of each method, worst exceedance first among equals."""
    w = Window.partitionBy(KEY, "method").orderBy(F.desc("length"), F.desc("max_exceedance"), "cluster_start")
    return clusters.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def monthly_timing(matrix: DataFrame) -> DataFrame:
    return (
        matrix.filter(F.col("violation_method_count") > 0)
        .groupBy(KEY, "calendar_month")
        .agg(
            F.count(F.lit(1)).alias("exception_dates"),
            F.sum("violation_method_count").alias("method_level_violations"),
        )
        .orderBy(F.desc("method_level_violations"), F.desc("exception_dates"), "calendar_month", KEY)
    )


def cluster_timing(clustered: DataFrame) -> DataFrame:
    return (
        clustered.groupBy(KEY, "cluster_id")
        .agg(
            F.min("target_date").alias("cluster_start"),
            F.max("target_date").alias("cluster_end"),
            F.count(F.lit(1)).alias("exception_dates"),
            F.sum("violation_method_count").alias("method_level_violations"),
            F.min("actual_return").alias("minimum_actual_return"),
        )
        .orderBy(
            F.desc("method_level_violations"), F.desc("exception_dates"), "minimum_actual_return", "cluster_start", KEY
        )
    )


# Reported case per exception category.
CASES = {
    "shared_all_3": "most_severe_shared",
    "historical_only": "most_severe_historical_only",
    "ewma_only": "most_severe_ewma_only",
    "gb_only": "most_severe_gb_only",
}


def severe_cases(matrix: DataFrame, gap: int = 2) -> DataFrame:
    """Worst session of each category and the largest cluster; an absent category keeps a placeholder row."""
    worst = matrix.groupBy(KEY, "exception_category").agg(
        F.min_by("target_date", F.struct("actual_return", "target_date")).alias("target_date"),
        F.min("actual_return").alias("actual_return"),
    )
    slots = F.array(
        *[F.struct(F.lit(c).alias("exception_category"), F.lit(n).alias("case_type")) for c, n in CASES.items()]
    )
    wanted = matrix.select(KEY).distinct().select(KEY, F.inline(slots))
    no_date = F.lit(None).cast("date")
    no_count = F.lit(None).cast("long")
    categories = wanted.join(worst, [KEY, "exception_category"], "left").select(
        KEY,
        "case_type",
        "target_date",
        "actual_return",
        F.when(F.col("actual_return").isNull(), "not_available").otherwise(F.col("exception_category")).alias(
            "exception_category"
        ),
        no_date.alias("cluster_start"), no_date.alias("cluster_end"), no_count.alias("exception_dates"),
        no_count.alias("method_level_violations"),
    )
    size = F.struct(
        F.col("method_level_violations"), F.col("exception_dates"), -F.col("minimum_actual_return"),
        -F.unix_date("cluster_start"),
    )
    top = cluster_timing(near_clusters(matrix, gap)).groupBy(KEY).agg(
        *[
            F.max_by(c, size).alias(c)
            for c in ("minimum_actual_return", "cluster_start", "cluster_end", "exception_dates",
                      "method_level_violations")
        ]
    )
    largest = top.select(
        KEY,
        F.lit("largest_multi_method_cluster").alias("case_type"),
        no_date.alias("target_date"),
        F.col("minimum_actual_return").alias("actual_return"),
        F.lit("cluster").alias("exception_category"),
        "cluster_start", "cluster_end", "exception_dates", "method_level_violations",
    )
    return categories.unionByName(largest)


def monthly_exceptions(predictions: DataFrame) -> DataFrame:
    """Violations, targets and rate per method and month, every month of the span present."""
    month = F.trunc("target_date", "month")
    counted = predictions.groupBy(KEY, "method", month.alias("month")).agg(
        F.count(F.lit(1)).alias("targets"), F.count_if("violation").alias("violations")
    )
    spine = counted.groupBy(KEY, "method").agg(F.min("month").alias("_a"), F.max("month").alias("_b")).select(
        KEY, "method", F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("month")
    )
    return spine.join(counted, [KEY, "method", "month"], "left").select(
        KEY,
        "method",
        F.date_format("month", "yyyy-MM").alias("calendar_month"),
        F.coalesce("targets", F.lit(0)).alias("targets"),
        F.coalesce("violations", F.lit(0)).alias("violations"),
        F.try_divide("violations", "targets").alias("violation_rate"),
    )


def quantile_timeline(predictions: DataFrame, methods: Mapping[str, str] = METHOD_PREFIX) -> DataFrame:
    return predictions.groupBy(KEY, "target_date").agg(
        F.max("actual_return").alias("actual_return"),
        *[_of(m, F.col("quantile_return")).alias(f"{p}_quantile") for m, p in methods.items()],
    )


def exception_overlap(matrix: DataFrame, left: str = "historical", right: str = "ewma") -> DataFrame:
    a, b = flag(left) == 1, flag(right) == 1
    counted = matrix.groupBy(KEY).agg(
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("left_only"),
        F.count_if(~a & b).alias("right_only"),
        F.count_if(a | b).alias("union_count"),
    )
    return counted.withColumns(
        {
            "jaccard": F.try_divide("both", "union_count"),
            "share_of_left": F.try_divide(F.col("both"), F.col("both") + F.col("left_only")),
            "share_of_right": F.try_divide(F.col("both"), F.col("both") + F.col("right_only")),
        }
    )


def exceedance() -> Column:
    return F.greatest(F.lit(0.0), F.col("quantile_return") - F.col("actual_return"))


def exceedance_severity(predictions: DataFrame) -> DataFrame:
    return predictions.filter("violation").groupBy(KEY, "method").agg(
        F.count(F.lit(1)).alias("violations"),
        F.avg(exceedance()).alias("mean_exceedance"),
        F.percentile(exceedance(), F.lit(0.5)).alias("median_exceedance"),
        F.percentile(exceedance(), F.lit(0.25)).alias("q25_exceedance"),
        F.percentile(exceedance(), F.lit(0.75)).alias("q75_exceedance"),
        F.percentile(exceedance(), F.lit(0.9)).alias("q90_exceedance"),
        F.max(exceedance()).alias("max_exceedance"),
    )


def worst_exceedances(predictions: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy(KEY, "method").orderBy(F.desc("exceedance"), "target_date")
    return (
        predictions.filter("violation")
        .withColumn("exceedance", exceedance())
        .withColumn("rank", F.row_number().over(w).cast("long"))
        .filter(F.col("rank") <= n)
        .select(KEY, "method", "rank", "target_date", "actual_return", "quantile_return", "exceedance")
    )


def two_model_frame(predictions: DataFrame, left: str = "historical_simulation", right: str = "ewma") -> DataFrame:
    """Both baselines side by side with exceedance and exception type."""
    names = {left: "historical", right: "ewma"}
    columns = [F.max("actual_return").alias("actual_return")]
    for method, prefix in names.items():
        columns += [
            _of(method, F.col("violation")).alias(f"{prefix}_violation"),
            _of(method, F.col("var")).alias(f"{prefix}_var"),
            _of(method, exceedance()).alias(f"{prefix}_exceedance"),
        ]
    return (
        predictions.filter(F.col("method").isin(left, right))
        .groupBy(KEY, "target_date")
        .agg(*columns)
        .withColumn("exception_type", classify_exception(("historical", "ewma")))
    )


def case_studies(frame: DataFrame, cap: int = 10) -> DataFrame:
    """Two worst shared, one worst of each exclusive kind and the longest historical cluster."""
    combined = F.greatest("historical_exceedance", "ewma_exceedance")
    kinds = {"both": (2, combined, "top_shared_severity"),
             "historical_only": (1, F.col("historical_exceedance"), "top_historical_only_severity"),
             "ewma_only": (1, F.col("ewma_exceedance"), "top_ewma_only_severity")}
    severity = F.lit(None).cast("double")
    reason = F.lit(None).cast("string")
    quota = F.lit(0)
    for kind, (n, value, label) in kinds.items():
        same = F.col("exception_type") == kind
        severity = F.when(same, value).otherwise(severity)
        reason = F.when(same, F.lit(label)).otherwise(reason)
        quota = F.when(same, F.lit(n)).otherwise(quota)
    best = Window.partitionBy(KEY, "exception_type").orderBy(F.desc("_severity"), "target_date")
    tops = (
        frame.filter(F.col("exception_type") != "none")
        .withColumns({"_severity": severity, "selection_reason": reason, "_quota": quota})
        .withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") <= F.col("_quota"))
        .drop("_severity", "_quota", "_rank")
    )
    w = Window.partitionBy(KEY).orderBy("target_date")
    runs = (
        frame.withColumn("_position", F.row_number().over(w))
        .filter("historical_violation")
        .withColumn("_run", F.col("_position") - F.row_number().over(w))
    )
    longest = runs.groupBy(KEY, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.max("historical_exceedance").alias("_worst"), F.min("target_date").alias("_at")
    ).groupBy(KEY).agg(F.max_by("_run", F.struct(F.col("_n"), F.col("_worst"), -F.unix_date("_at"))).alias("_run"))
    cluster = (
        runs.join(longest, [KEY, "_run"])
        .drop("_run", "_position")
        .withColumn("selection_reason", F.lit("longest_historical_exception_cluster"))
    )
    chosen = tops.unionByName(cluster)
    first = Window.partitionBy(KEY, "target_date").orderBy("selection_reason")
    return (
        chosen.withColumn("_copy", F.row_number().over(first))
        .filter(F.col("_copy") == 1)
        .withColumn("_case", F.row_number().over(w))
        .filter(F.col("_case") <= cap)
        .withColumn("case_id", F.format_string("C%02d", F.col("_case")))
        .drop("_copy", "_case")
    )


def shock_response(predictions: DataFrame, n: int = 20, tolerance: float = 1e-15) -> DataFrame:
    """How the next forecast reacts to the n largest absolute returns."""
    w = Window.partitionBy(KEY, "method").orderBy("target_date")
    largest = Window.partitionBy(KEY, "method").orderBy(F.desc("_size"), "target_date")
    steps = (
        predictions.withColumn("_change", F.lead("var").over(w) - F.col("var"))
        .filter(F.col("_change").isNotNull())
        .withColumn("_size", F.abs("actual_return"))
        .withColumn("_top", F.row_number().over(largest) <= n)
    )
    change = F.when(F.col("_top"), F.col("_change"))
    return steps.groupBy(KEY, "method").agg(
        F.count_if(F.col("_top") & (F.col("_change") > 0)).alias("increases"),
        F.count_if(F.col("_top") & (F.abs("_change") <= tolerance)).alias("unchanged"),
        F.count_if(F.col("_top") & (F.col("_change") < 0)).alias("decreases"),
        F.avg(change).alias("mean_change"),
        F.percentile(change, F.lit(0.5)).alias("median_change"),
        F.max(change).alias("max_increase"),
        F.corr("_size", "_change").alias("correlation"),
    )


def episode(predictions: DataFrame, cases: DataFrame, pad: int = 15) -> DataFrame:
    """Predictions from ``pad`` days before the first to ``pad`` days after the last case of a series."""
    span = cases.groupBy(KEY).agg(
        F.date_sub(F.min("target_date"), pad).alias("_from"), F.date_add(F.max("target_date"), pad).alias("_to")
    )
    return (
        predictions.join(span, KEY)
        .filter(F.col("target_date").between(F.col("_from"), F.col("_to")))
        .drop("_from", "_to")
    )
