import math

import pytest
from pyspark.sql import functions as F

from tailgauge.operators import alignment as J
from tailgauge.operators import features as X
from tailgauge.operators import returns as R
from tailgauge.operators.blocked import number_sessions, with_running_log_wealth


def table(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def same(a, b, keys, tolerance=1e-12):
    left, right = table(a, *keys), table(b, *keys)
    assert left.keys() == right.keys()
    for key, row in left.items():
        for name, value in row.items():
            other = right[key][name]
            if isinstance(value, float):
                assert other == pytest.approx(value, abs=tolerance, rel=tolerance), (key, name)
            else:
                assert other == value, (key, name)


def test_simple_return_and_portfolio(spark, panel):
    first = R.simple_return(panel).filter(F.col("ticker") == "AAA").orderBy("date").collect()
    assert first[0].simple_return is None and first[1].simple_return == pytest.approx(0.01)
    built = R.build_portfolio(panel, 3).orderBy("date").collect()
    expected = (1 / 100 + 1 / 110 + 1 / 120) / 3
    assert len(built) == 39 and built[0].portfolio_simple_return == pytest.approx(expected)
    assert built[0].portfolio_log_return == pytest.approx(math.log1p(expected))


def test_missing_member_leaves_the_date_incomplete(spark, panel):
    returns = R.simple_return(panel).filter("simple_return IS NOT NULL")
    hole = returns.filter(~((F.col("ticker") == "BBB") & (F.col("date") == "2020-01-10")))
    weights = R.equal_weights(panel.select(F.lit("P").alias("portfolio_id"), "ticker"))
    rows = table(R.portfolio_return(hole, weights), "date")
    broken = [k for k, r in rows.items() if not r["complete"]]
    assert len(broken) == 1 and rows[broken[0]]["portfolio_simple_return"] is None


def test_weights(spark):
    schema = "portfolio_id string, ticker string, weight double"
    rows = [("a", "x", 0.5), ("a", "y", 0.5), ("b", "x", 1.5), ("b", "y", -0.5), ("c", "x", 0.4), ("c", "y", float("nan"))]
    checked = table(R.validate_weights(spark.createDataFrame(rows, schema)), "portfolio_id")
    assert checked["a",]["valid"] and not checked["b",]["valid"] and not checked["c",]["valid"]
    assert checked["c",]["not_finite"] == 1


def test_drawdown_starts_at_the_initial_capital(spark):
    rows = [("s", d, r) for d, r in zip(("2024-01-01", "2024-01-02", "2024-01-03"), (-0.1, 0.05, 0.2))]
    df = spark.createDataFrame(rows, "series_id string, d string, ret double").selectExpr("series_id", "to_date(d) AS date", "ret")
    run = [r.drawdown for r in R.wealth_drawdown(df).orderBy("date").collect()]
    assert run == pytest.approx([-0.1, 0.9 * 1.05 - 1, 0.0])
    lagged = [r.drawdown for r in X.lagged_drawdown(df).orderBy("date").collect()]
    assert lagged[0] is None and lagged[1:] == pytest.approx([0.0, 0.0])


def test_features_by_hand(spark, series):
    rows = X.feature_table_12f(series).filter("series_id = 'P'").orderBy("target_date").collect()
    values = [r.ret for r in series.filter("series_id = 'P'").orderBy("date").collect()]
    t = len(values) - len(rows)
    assert t == 60
    past = values[:t]
    row = rows[0]
    assert row.actual_return == values[t] and row.return_lag_1 == past[-1] and row.return_lag_5 == past[-5]
    mean = sum(past[-5:]) / 5
    assert row.rolling_vol_5 == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in past[-5:]) / 4))
    assert row.momentum_5 == pytest.approx(math.prod(1 + v for v in past[-5:]) - 1)
    assert row.downside_vol_20 == pytest.approx(math.sqrt(sum(min(v, 0) ** 2 for v in past[-20:]) / 20))
    assert row.rolling_range_20 == pytest.approx(max(past[-20:]) - min(past[-20:]))
    ordered = sorted(past[-60:])
    assert row.rolling_q05_60 == pytest.approx(ordered[2] + 0.95 * (ordered[3] - ordered[2]))
    wealth, peak = 1.0, -1.0
    for v in past:
        wealth *= 1 + v
        peak = max(peak, wealth)
    assert row.drawdown == pytest.approx(wealth / peak - 1)


@pytest.mark.parametrize("block", [7, 64])
def test_chunks_do_not_change_features(spark, series, block):
    same(X.feature_table_12f(series), X.feature_table_12f(series, block=block), ("series_id", "target_date"))


@pytest.mark.parametrize("days", [7, 50])
def test_slices_do_not_change_running_values(spark, series, days):
    same(with_running_log_wealth(series), with_running_log_wealth(series, days=days), ("series_id", "date"))
    numbered = number_sessions(series, days=days)
    for name, n in (("P", 169), ("Q", 84)):
        positions = sorted(r.position for r in numbered.filter(F.col("series_id") == name).collect())
        assert positions == list(range(len(positions))) and len(positions) == series.filter(F.col("series_id") == name).count()


def test_the_future_does_not_change_features(spark, series):
    cut = "2020-05-01"
    disturbed = series.withColumn("ret", F.when(F.col("date") >= cut, F.col("ret") * 3 + 0.01).otherwise(F.col("ret")))
    before = F.col("target_date") <= cut
    a = X.feature_table_12f(series).filter(before).drop("actual_return")
    b = X.feature_table_12f(disturbed).filter(before).drop("actual_return")
    assert a.count() > 0
    same(a, b, ("series_id", "target_date"))


def test_market_features_are_moved_to_the_next_target(spark, panel):
    index = panel.filter(F.col("ticker") == "AAA").withColumn("ticker", F.lit("MKT"))
    rows = X.market_feature_table(panel, index, 3).orderBy("target_date").collect()
    assert rows[0].portfolio_range is None
    assert rows[1].portfolio_range == pytest.approx((4 / 100 + 4 / 110 + 4 / 120) / 3)
    assert rows[2].market_return_lag_1 == pytest.approx(0.01)
    assert rows[20].market_vol_20 is None and rows[21].market_vol_20 is not None
    cut = panel.agg(F.max("date")).first()[0]
    louder = panel.withColumn("volume", F.when(F.col("date") == cut, F.col("volume") * 9).otherwise(F.col("volume")))
    same(
        X.market_feature_table(panel, index, 3), X.market_feature_table(louder, index, 3), ("target_date",)
    )


def test_zero_volume_gives_no_change(spark, panel):
    one = panel.filter(F.col("ticker") == "AAA")
    silent = one.withColumn("volume", F.when(F.col("date") == "2020-01-10", 0).otherwise(F.col("volume")))
    rows = table(X.volume_change(silent), "date")
    missing = [str(k[0]) for k, r in rows.items() if r["volume_change"] is None]
    assert missing == ["2020-01-01", "2020-01-13"] or sorted(missing) == ["2020-01-01", "2020-01-13"]


def test_alignment(spark, panel):
    hole = panel.filter(~((F.col("ticker") == "BBB") & (F.col("date") == "2020-01-10")))
    assert J.align_calendars(hole, 3).count() == 39 * 3
    assert J.align_calendars(hole).count() == 39 * 3
    assert [str(r.date) for r in J.calendar_mismatch(hole, 3).collect()] == ["2020-01-10"]


def test_history_revision_blocks(spark, panel):
    old = panel.filter(F.col("date") <= "2020-02-01")
    new = panel.filter(F.col("date") > "2020-01-20")
    assert J.merge_history(old, new).count() == panel.count()
    with pytest.raises(ValueError, match="revised historical close"):
        J.merge_history(old, new.withColumn("close", F.col("close") + 0.01))


def test_previous_session_is_strict(spark, series):
    target = spark.sql("SELECT 'P' AS series_id, DATE'2020-01-04' AS target_date UNION ALL SELECT 'P', DATE'2020-01-03'"
                       " UNION ALL SELECT 'P', DATE'2019-12-31'")
    rows = table(J.previous_session(target, series), "target_date")
    found = {str(k[0]): r["as_of"] and str(r["as_of"]) for k, r in rows.items()}
    assert found == {"2020-01-04": "2020-01-03", "2020-01-03": "2020-01-02", "2019-12-31": None}


def test_training_rows_ranges(spark, series):
    numbered = number_sessions(series).filter("series_id = 'P'")
    n = numbered.count()
    for rolling in (None, 30):
        got = {}
        for r in J.training_rows(numbered, 4, 50, 20, rolling).collect():
            got.setdefault(r.task, set()).add(r.position)
        want = {k: {p for p in range(n) if p < 50 + 20 * k and (rolling is None or p >= 50 + 20 * k - rolling)} for k in range(4)}
        assert got == want


def test_enrich_guards(spark):
    facts = spark.createDataFrame([(1,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert J.enrich_many_to_one(facts, dim, ["k"]).count() == 2
    with pytest.raises(ValueError, match="not unique"):
        J.enrich_many_to_one(facts, dim.union(dim), ["k"])
    with pytest.raises(ValueError, match="without a match"):
        J.enrich_many_to_one(facts, dim.filter("k = 1"), ["k"])
