import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tailgauge.functions import (
    chi_square_tail, coerce_numeric, eligible_session, erfc, parse_flag, parse_trading_date, pinball,
)
from tailgauge.operators.coverage import with_independence, with_kupiec


def test_erfc_matches_the_library(spark):
    xs = [i / 20 for i in range(0, 200)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert max(abs(r.y - math.erfc(r.x)) for r in rows) < 1e-14


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-07-29 20:00:00", date(2026, 7, 30)),
        ("2026-07-29 07:00:00+07:00", date(2026, 7, 29)),
        ("2026-07-29", date(2026, 7, 29)),
        (" 2026/07/29 ", date(2026, 7, 29)),
        ("29th of July", None),
        ("", None),
    ],
)
def test_trading_date_is_the_exchange_day(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(parse_trading_date(F.col("t")).alias("d")).first()
    assert row.d == expected


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("1.5", "True"), ("abc", " false "), ("NaN", "yes"), ("", None)], "n string, f string")
    rows = df.select(coerce_numeric(F.col("n")).alias("n"), parse_flag(F.col("f")).alias("f")).collect()
    assert [tuple(r) for r in rows] == [(1.5, True), (None, False), (None, None), (None, None)]


@pytest.mark.parametrize(
    "instant, expected",
    [
        ("2026-07-31 10:00:00", date(2026, 7, 31)),  # Friday 17:00 local
        ("2026-07-31 09:59:59", date(2026, 7, 30)),
        ("2026-08-02 12:00:00", date(2026, 7, 31)),  # Sunday
        ("2026-08-03 01:00:00", date(2026, 7, 31)),  # Monday before the close
    ],
)
def test_eligible_session(spark, instant, expected):
    df = spark.sql(f"SELECT TIMESTAMP '{instant}' AS t").select(eligible_session(F.col("t")).alias("d"))
    assert df.first().d == expected


def test_pinball_penalises_misses_more(spark):
    row = spark.sql("SELECT -0.05D AS a, -0.02D AS q").select(pinball(F.col("a"), F.col("q")).alias("l")).first()
    assert row.l == pytest.approx(0.95 * 0.03)


@pytest.mark.parametrize(
    "n, x, ratio, p",
    [
        (468, 25, 0.112755029552, 0.737029113207),
        (468, 28, 0.897993653792, 0.343320256532),
        (468, 24, 0.016064864336, 0.899140450559),
    ],
)
def test_kupiec_published_values(spark, n, x, ratio, p):
    row = with_kupiec(spark.createDataFrame([(n, x)], "n_targets long, n_violations long")).first()
    assert row.kupiec_lr == pytest.approx(ratio, abs=1e-10)
    assert row.kupiec_p_value == pytest.approx(p, abs=1e-10)
    assert row.kupiec_decision == "do_not_reject_H0" and not row.boundary_observation


@pytest.mark.parametrize("x", [0, 100])
def test_kupiec_is_finite_at_the_bounds(spark, x):
    row = with_kupiec(spark.createDataFrame([(100, x)], "n_targets long, n_violations long")).first()
    expected = -200 * math.log(0.95) if x == 0 else -200 * math.log(0.05)
    assert row.kupiec_lr == pytest.approx(expected) and row.boundary_observation and row.kupiec_reject


def test_independence_published_value(spark):
    df = spark.createDataFrame([(420, 23, 22, 2)], "n00 long, n01 long, n10 long, n11 long")
    row = with_independence(df).first()
    assert row.lr_ind == pytest.approx(0.385547621738, abs=1e-10)
    assert row.p_ind == pytest.approx(0.534649, abs=1e-6)


def test_tail_of_zero_is_one(spark):
    assert spark.sql("SELECT 0.0D AS x").select(chi_square_tail(F.col("x")).alias("p")).first().p == 1.0
