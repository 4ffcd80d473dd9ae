from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tailgauge.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def sessions(n: int, start: date = date(2020, 1, 1)) -> list[date]:
    """n weekdays."""
    days, day = [], start
    while len(days) < n:
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    return days


@pytest.fixture(scope="session")
def series(spark):
    """Two return series of different length with gaps in the calendar."""
    rows = []
    for name, n, a in (("P", 180, 0.01), ("Q", 90, 0.02)):
        for i, day in enumerate(sessions(n)):
            if i % 17 == 3:
                continue
            rows.append((name, day, a * (((i * 37) % 23) / 11.0 - 1.0)))
    return spark.createDataFrame(rows, "series_id string, date date, ret double").cache()


@pytest.fixture(scope="session")
def panel(spark):
    """Three tickers on the same weekdays, close = 100 + i, volume = base + i."""
    rows = []
    for k, ticker in enumerate(("AAA", "BBB", "CCC")):
        for i, day in enumerate(sessions(40)):
            close = 100.0 + i + 10 * k
            rows.append((ticker, day, close - 1, close + 2, close - 2, close, 1000.0 * (k + 1) + i))
    schema = "ticker string, date date, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(rows, schema).cache()
