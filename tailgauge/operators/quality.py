"""The per-ticker quality report of a raw panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cleaning import breaks_ohlc, earlier_dates, session_state, structural_counts, with_seen_before

COUNTS = [
    "raw_rows", "clean_rows", "rows_removed", "date_parse_failures", "missing_rows", "duplicate_date_rows",
    "nonpositive_price_rows", "negative_volume_rows", "invalid_ohlc_rows", "extreme_close_move_rows",
]
ISSUES = [
    "date_parse_failures", "missing_rows", "duplicate_date_rows", "nonpositive_price_rows", "negative_volume_rows",
    "invalid_ohlc_rows", "extreme_close_move_rows",
]


def quality_report(raw: DataFrame, requested: Sequence[str], location: str = "clean",
                   threshold: float = 0.15) -> DataFrame:
    """One row per requested ticker: PASS, REVIEW or, without input, FAIL.

    The raw rows are read once: they shrink to one state row per session, and
    all measures of a ticker come from one aggregation of its sessions.
    """
    sound = (F.col("kept") > 0) & ~breaks_ohlc()
    before = F.last(F.when(sound, F.col("close")), ignorenulls=True).over(earlier_dates())
    move = F.when(sound, F.try_divide(F.col("close"), before) - 1.0)
    measured = (
        with_seen_before(session_state(raw))
        .withColumn("_move", move)
        .groupBy("ticker")
        .agg(
            *structural_counts(),
            F.count_if((F.col("kept") > 0) & breaks_ohlc()).alias("invalid_ohlc_rows"),
            F.count_if(sound).alias("clean_rows"),
            F.min(F.when(sound, F.col("date"))).alias("start_date"),
            F.max(F.when(sound, F.col("date"))).alias("end_date"),
            F.count_if(F.abs("_move") > threshold).alias("extreme_close_move_rows"),
        )
    )
    wanted = raw.sparkSession.createDataFrame([(t.strip().upper(),) for t in requested], "ticker string")
    report = (
        wanted.join(measured, "ticker", "left")
        .withColumn("_found", F.col("raw_rows").isNotNull())
        .withColumn("rows_removed", F.col("raw_rows") - F.col("clean_rows"))
        .fillna(0, COUNTS)
        .fillna({"dates_out_of_order": False})
    )
    issue = F.col("dates_out_of_order")
    for name in ISSUES:
        issue = issue | (F.col(name) > 0)
    return report.select(
        "ticker",
        F.when(~F.col("_found"), "FAIL").when(issue, "REVIEW").otherwise("PASS").alias("quality_status"),
        "raw_rows",
        "clean_rows",
        "rows_removed",
        "date_parse_failures",
        "missing_rows",
        "duplicate_date_rows",
        "nonpositive_price_rows",
        "negative_volume_rows",
        "invalid_ohlc_rows",
        "dates_out_of_order",
        "extreme_close_move_rows",
        F.coalesce(F.date_format("start_date", "yyyy-MM-dd"), F.lit("")).alias("start_date"),
        F.coalesce(F.date_format("end_date", "yyyy-MM-dd"), F.lit("")).alias("end_date"),
        F.when(F.col("_found"), F.concat(F.lit(location + "/ticker="), F.col("ticker"))).otherwise("").alias(
            "processed_file"
        ),
        F.when(F.col("_found"), "success").otherwise("missing_input").alias("pipeline_status"),
    )
