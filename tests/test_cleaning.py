from datetime import date

import pytest
from pyspark.sql import functions as F

from tailgauge.operators import cleaning as C
from tailgauge.operators.quality import quality_report

RAW = "ticker string, ordinal long, date string, open string, high string, low string, close string, volume string"
DAY = date(2024, 1, 31)


def raw(spark, *rows):
    return spark.createDataFrame([("aaa", i, *r) for i, r in enumerate(rows)], RAW)


GOOD = ("2024-01-02", "10", "12", "9", "11", "100")


def test_the_last_copy_in_file_order_wins(spark):
    df = raw(spark, ("2024-01-02", "10", "12", "9", "10.5", "1"), ("2024-01-02", "10", "12", "9", "11.5", "2"))
    rows = C.clean_structural(df).collect()
    assert [(r.ticker, r.close, r.volume) for r in rows] == [("AAA", 11.5, 2.0)]


def test_structural_counts(spark):
    df = raw(
        spark,
        GOOD,
        ("2024-01-04", "10", "12", "9", "11", "100"),
        ("2024-01-03", "10", "12", "9", "11", "100"),
        ("2024-01-03", "10", "12", "9", "11", "-1"),
        ("oops", "10", "12", "9", "11", "100"),
        ("2024-01-05", "0", "12", "9", "11", "100"),
        ("2024-01-08", "abc", "12", "9", "11", "100"),
    )
    row = C.structural_diagnostics(df).first()
    assert row.raw_rows == 7 and row.date_parse_failures == 1 and row.missing_rows == 2
    assert row.duplicate_date_rows == 2 and row.nonpositive_price_rows == 1 and row.negative_volume_rows == 1
    assert row.dates_out_of_order


def test_repeated_dates_in_order_are_not_out_of_order(spark):
    df = raw(spark, GOOD, GOOD, ("2024-01-03", "10", "12", "9", "11", "100"))
    assert not C.structural_diagnostics(df).first().dates_out_of_order


def test_interleaved_copies_are_out_of_order(spark):
    df = raw(spark, GOOD, ("2024-01-03", "10", "12", "9", "11", "100"), GOOD)
    assert C.structural_diagnostics(df).first().dates_out_of_order


def test_report_statuses(spark):
    calm = [("2024-01-02", "10", "12", "9", "11", "1"), ("2024-01-03", "10", "12", "9", "11.1", "1")]
    df = raw(spark, *calm).unionByName(raw(spark, *calm, calm[0]).withColumn("ticker", F.lit("bbb")))
    rows = {r.ticker: r for r in quality_report(df, ["aaa", "bbb", "ccc"]).collect()}
    assert rows["AAA"].quality_status == "PASS" and rows["AAA"].pipeline_status == "success"
    assert rows["BBB"].quality_status == "REVIEW" and rows["BBB"].rows_removed == 1
    assert rows["CCC"].quality_status == "FAIL" and rows["CCC"].start_date == "" and rows["CCC"].raw_rows == 0


def test_extreme_moves_are_flagged_not_removed(spark, panel):
    jump = panel.withColumn("close", F.when(F.col("date") == "2020-01-10", F.col("close") * 2).otherwise(F.col("close")))
    flagged = C.flag_extreme_moves(jump)
    assert {str(r.date) for r in flagged.collect()} == {"2020-01-10", "2020-01-13"}


@pytest.mark.parametrize(
    "bad, rule",
    [
        (("x", "10", "12", "9", "11", "1"), "invalid_date"),
        (GOOD, "duplicate_dates"),
        (("2024-01-03", "", "12", "9", "11", "1"), "not_finite"),
        (("2024-01-03", "Infinity", "12", "9", "11", "1"), "not_finite"),
        (("2024-01-03", "0", "12", "9", "11", "1"), "nonpositive_price"),
        (("2024-01-03", "10", "12", "9", "11", "-1"), "negative_volume"),
        (("2024-01-03", "10", "10.5", "9", "11", "1"), "invalid_ohlc"),
    ],
)
def test_strict_policy_raises(spark, bad, rule):
    with pytest.raises(ValueError, match=rule):
        C.strict_normalize(raw(spark, GOOD, bad), F.lit(DAY))


def test_strict_policy_ignores_rows_after_the_cutoff(spark):
    late = ("2024-02-01", "0", "12", "9", "11", "1")
    assert C.strict_normalize(raw(spark, GOOD, late), F.lit(DAY)).count() == 1


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "`  Time ` int, `Adj Close-Price` int")
    assert C.normalize_columns(df).columns == ["date", "adj_close_price"]
    with pytest.raises(ValueError, match="volume"):
        C.require_columns(df.toDF("date", "close"))


def test_reviewed_anomaly_is_excluded_and_others_stop(spark, panel):
    broken = panel.withColumn("high", F.when(F.col("date") == "2020-01-10", F.col("close") - 3).otherwise(F.col("high")))
    one = broken.filter(F.col("ticker") == "AAA")
    gap = C.anomaly_gaps(one).first().max_gap_points
    known = spark.createDataFrame([("AAA", date(2020, 1, 10), gap + 0.01)], "ticker string, date date, gap double")
    clean, audit = C.filter_reviewed_anomalies(one, known)
    assert clean.count() == one.count() - 1 and audit.count() == 1
    with pytest.raises(ValueError, match="unreviewed"):
        C.filter_reviewed_anomalies(one, known.withColumn("gap", F.col("gap") + 1))
    changed = audit.withColumn("close", F.col("close") + 1e-3)
    assert C.reconcile_anomaly_audit(audit, audit).count() == 1
    with pytest.raises(ValueError, match="changed"):
        C.reconcile_anomaly_audit(audit, changed)


def test_price_units(spark, panel):
    units = panel.withColumn("price_unit", F.lit("vnd"))
    assert C.rescale_price_unit(units).filter(F.col("ticker") == "AAA").orderBy("date").first().close == 0.1
    with pytest.raises(Exception, match="unsupported price unit"):
        C.rescale_price_unit(panel.withColumn("price_unit", F.lit("usd"))).collect()


def test_periods(spark, panel):
    assert C.filter_period(panel, "YTD").count() == panel.count()
    assert C.filter_period(panel, "1M").agg(F.min("date")).first()[0] >= date(2020, 1, 25)
    with pytest.raises(ValueError):
        C.filter_period(panel, "2W")


def test_availability_states(spark, panel):
    audit = spark.createDataFrame([("AAA", date(2020, 1, 10))], "ticker string, date date")
    bars = panel.filter(~((F.col("ticker") == "AAA") & F.col("date").isin(date(2020, 1, 10), date(2020, 1, 13))))
    bars = bars.withColumn("low", F.when((F.col("ticker") == "BBB") & (F.col("date") == "2020-01-10"), 999).otherwise(F.col("low")))
    states = {(str(r.date), r.ticker): r.state for r in C.availability_matrix(bars, ["AAA", "BBB"], audit).collect()}
    assert states["2020-01-10", "AAA"] == "excluded" and states["2020-01-13", "AAA"] == "absent"
    assert states["2020-01-10", "BBB"] == "invalid" and states["2020-01-13", "BBB"] == "valid"
