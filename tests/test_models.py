import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import sessions
from tailgauge.models.ewma import ewma_path, ewma_var
from tailgauge.models.folds import dev_holdout_split, expanding_folds, fold_training_rows, require_split_sizes
from tailgauge.models.forecast import monetary_var, next_session_forecast
from tailgauge.models.historical import historical_var, rolling_historical_var
from tailgauge.models.quantile_boosting import Candidate, QuantileGBT, forecast_one
from tailgauge.models.refits import cv_predictions, cv_staged_loss, walk_forward_model
from tailgauge.operators.features import FEATURES_7, feature_table_12f
from tailgauge.models.walk_forward import compare_methods, empirical_quantile, python_forecaster, walk_forward

Z = -1.6448536269514726


def returns(spark, values, name="s"):
    rows = [(name, d, v) for d, v in zip(sessions(len(values)), values)]
    return spark.createDataFrame(rows, "series_id string, date date, ret double")


def test_quantile_is_linear(spark):
    row = historical_var(returns(spark, [-0.03, -0.02, -0.01, 0.01, 0.02])).first()
    assert row.quantile_return == pytest.approx(-0.028) and row["var"] == pytest.approx(0.028)


def test_var_is_never_negative(spark):
    assert historical_var(returns(spark, [0.01, 0.02])).first()["var"] == 0.0


def test_ewma_first_state_and_path(spark):
    values = [0.01, -0.02, 0.03, -0.01, 0.02, -0.03] * 20
    one = ewma_var(returns(spark, values[:1])).first()
    assert one.quantile_return == pytest.approx(Z * 0.01)
    state, expected = None, []
    for v in values:
        expected.append(None if state is None else Z * math.sqrt(state))
        state = v * v if state is None else 0.94 * state + (1 - 0.94) * v * v
    for days in (5, 30, 1024):
        got = [r.quantile_return for r in ewma_path(returns(spark, values), days=days).orderBy("date").collect()]
        assert got[0] is None
        assert got[1:] == pytest.approx(expected[1:], rel=1e-12)
    assert ewma_var(returns(spark, values)).first().variance == pytest.approx(state, rel=1e-12)
    warm = [r.quantile_return for r in ewma_path(returns(spark, values), warmup=10).orderBy("date").collect()]
    assert warm[:10] == [None] * 10 and warm[10] == pytest.approx(expected[10])


def test_rolling_windows_end_before_the_target(spark, series):
    rows = rolling_historical_var(series, 30).filter("series_id = 'Q'").orderBy("target_date").collect()
    data = series.filter("series_id = 'Q'").orderBy("date").collect()
    assert rows[0].target_date == data[30].date and rows[0].window_start_date == data[0].date
    assert rows[0].forecast_date == data[29].date and rows[0].observations == 30
    assert len(rows) == len(data) - 30


def test_generic_walk_forward_agrees_with_the_specialised_one(spark, series):
    special = {(r.series_id, r.target_date): r.quantile_return for r in rolling_historical_var(series, 30).collect()}
    for forecaster in (empirical_quantile(), python_forecaster(lambda v: v.quantile(0.05))):
        general = {
            (r.series_id, r.target_date): r.quantile_return
            for r in walk_forward(series, forecaster, 30, "rolling", block=16).collect()
        }
        assert general.keys() == special.keys()
        assert all(general[k] == pytest.approx(special[k], abs=1e-12) for k in special)


def test_expanding_mode_uses_all_earlier_sessions(spark, series):
    rows = walk_forward(series, empirical_quantile(), 30, "expanding").filter("series_id = 'P'").orderBy("target_date").collect()
    values = [r.ret for r in series.filter("series_id = 'P'").orderBy("date").collect()]
    assert [r.train_rows for r in rows] == list(range(30, len(values)))
    past = sorted(values[:100])
    at = 0.05 * 99
    expected = past[int(at)] + (at - int(at)) * (past[int(at) + 1] - past[int(at)])
    assert rows[70].quantile_return == pytest.approx(expected)
    with pytest.raises(ValueError):
        walk_forward(series, empirical_quantile(), 30, "sideways")


def three_methods(returns):
    trees = walk_forward_model(feature_table_12f(returns), Candidate(2, 0.1, 2, 3), FEATURES_7, first=10, refit_every=7)
    return compare_methods(returns, trees, 40)


def test_the_future_does_not_change_forecasts(spark, series):
    cut = "2020-06-01"
    disturbed = series.withColumn("ret", F.when(F.col("date") >= cut, -F.col("ret") * 2).otherwise(F.col("ret")))
    keep = ["series_id", "method", "target_date", "as_of", "quantile_return"]

    def past(df):
        return {tuple(r) for r in three_methods(df).filter(F.col("target_date") <= cut).select(*keep).collect()}

    assert past(series) == past(disturbed) and past(series)


def test_strict_violation_and_common_targets(spark, series):
    rows = three_methods(series).collect()
    assert all(r.violation == (r.actual_return < r.quantile_return) for r in rows)
    assert all(r.as_of < r.target_date and r["var"] == max(0.0, -r.quantile_return) for r in rows)
    per_date = {}
    for r in rows:
        per_date.setdefault((r.series_id, r.target_date), set()).add(r.method)
    assert all(len(m) == 3 for m in per_date.values())


def test_next_session(spark, series):
    rows = {(r.series_id, r.method): r for r in next_session_forecast(series, window=50).collect()}
    assert len(rows) == 4 and rows["P", "ewma"].as_of == series.filter("series_id='P'").agg(F.max("date")).first()[0]
    assert monetary_var(next_session_forecast(series, 50), 100.0).first().monetary_var >= 0


def test_folds(spark):
    df = returns(spark, [0.01] * 32).withColumnRenamed("date", "target_date")
    folded = expanding_folds(df, 5)
    sizes = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert sizes == {0: 7, 1: 5, 2: 5, 3: 5, 4: 5, 5: 5}
    trained = {r.fold: r["count"] for r in fold_training_rows(folded, 5).groupBy("fold").count().collect()}
    assert trained == {1: 7, 2: 12, 3: 17, 4: 22, 5: 27}
    split = dev_holdout_split(df, date(2020, 1, 10))
    assert split.filter("part = 'development'").count() == 8
    with pytest.raises(ValueError):
        require_split_sizes(split, 10)


@pytest.fixture(scope="module")
def features(spark):
    """The outcome depends on x1 with a wide lower tail on one side; x2 is noise."""
    rows = []
    for name in ("P", "Q"):
        for i, day in enumerate(sessions(240)):
            x1, x2, u = (i * 7 % 10) / 10.0, (i * 13 % 17) / 17.0, ((i * 37) % 101) / 101.0 - 0.5
            rows.append((name, day, day, x1, x2, u * (3.0 if x1 < 0.5 else 1.0)))
    schema = "series_id string, target_date date, as_of date, x1 double, x2 double, actual_return double"
    return spark.createDataFrame(rows, schema).withColumn("as_of", F.date_sub("as_of", 1)).cache()


CONFIG = Candidate(stages=4, learning_rate=0.3, max_depth=2, min_leaf=10)


def test_boosting_learns_and_starts_at_the_quantile(spark, features):
    losses = cv_staged_loss(features, CONFIG, ["x1", "x2"], k=2).orderBy("series_id", "fold", "stage").collect()
    assert len(losses) == 2 * 2 * 5
    by_task = {}
    for r in losses:
        by_task.setdefault((r.series_id, r.fold), []).append(r.train_loss)
    for path in by_task.values():
        assert all(b <= a + 1e-12 for a, b in zip(path, path[1:])) and path[-1] < path[0]


def test_model_splits_on_the_informative_feature_and_respects_leaves(spark, features):
    model = QuantileGBT(["x1", "x2"], CONFIG).fit(features)
    first = model.nodes.filter("stage = 1 AND _node = 1 AND feature IS NOT NULL").collect()
    assert {r.task for r in first} == {"P", "Q"} and {r.feature for r in first} == {0}
    out = model.transform(features).cache()
    low = out.filter("x1 < 0.5").agg(F.avg("quantile_return")).first()[0]
    high = out.filter("x1 >= 0.5").agg(F.avg("quantile_return")).first()[0]
    assert low < high < 0
    share = out.filter("actual_return < quantile_return").count() / out.count()
    assert share < 0.12
    again = QuantileGBT(["x1", "x2"], CONFIG).fit(features).transform(features)
    assert out.exceptAll(again).isEmpty()
    assert forecast_one(model, features.filter("series_id = 'P'").limit(1)).first().quantile_return is not None
    with pytest.raises(ValueError):
        forecast_one(model, features)


def test_no_splits_gives_the_plain_quantile(spark, features):
    flat = Candidate(stages=1, learning_rate=1.0, max_depth=2, min_leaf=1000)
    row = QuantileGBT(["x1"], flat).fit(features).transform(features).filter("series_id = 'P'").first()
    values = sorted(r.actual_return for r in features.filter("series_id = 'P'").collect())
    # a leaf moves by the least residual that covers alpha of its rows
    assert row.quantile_return == pytest.approx(values[math.ceil(0.05 * len(values)) - 1])


def test_fold_predictions_do_not_see_the_future(spark, features):
    grid = {"a": CONFIG, "b": Candidate(2, 0.1, 1, 5, ("x2",))}
    names = ["series_id", "model", "fold", "target_date", "quantile_return"]
    base = cv_predictions(features, grid, ["x1", "x2"], k=2).select(*names)
    cut = expanding_folds(features, 2).filter("fold = 2").agg(F.min("target_date")).first()[0]
    disturbed = features.withColumn(
        "actual_return", F.when(F.col("target_date") >= F.lit(cut), F.col("actual_return") * 5).otherwise(F.col("actual_return"))
    )
    other = cv_predictions(disturbed, grid, ["x1", "x2"], k=2).select(*names)
    assert base.count() == 2 * 2 * 160
    assert base.exceptAll(other).isEmpty()


def test_refits_predict_every_later_session_once(spark, features):
    out = walk_forward_model(features, Candidate(1, 0.1, 1, 5), ["x1"], first=100, refit_every=50)
    rows = out.collect()
    assert len(rows) == 2 * 140 and len({(r.series_id, r.target_date) for r in rows}) == len(rows)
    assert {r.refit for r in rows} == {"0", "1", "2"}


@pytest.mark.parametrize("block, alpha", [(7, 0.05), (7, 0.95), (64, 0.5), (4096, 0.05)])
def test_expanding_quantiles_in_blocks_equal_sorting_the_past(spark, series, block, alpha):
    spread = series.withColumn("ret", F.when(F.col("series_id") == "Q", F.round("ret", 2)).otherwise(F.col("ret")))  # with ties
    got = {(r.series_id, r.target_date): r for r in walk_forward(spread, empirical_quantile(alpha), 30, "expanding", block=block).collect()}
    want = {(r.series_id, r.target_date): r for r in walk_forward(spread, empirical_quantile(alpha), 30, "expanding").collect()}
    assert got.keys() == want.keys() and len(got) > 150
    for k, r in want.items():
        assert (got[k].as_of, got[k].train_start, got[k].train_rows) == (r.as_of, r.train_start, r.train_rows)
        assert got[k].quantile_return == pytest.approx(r.quantile_return, abs=1e-15)
    with pytest.raises(ValueError, match="cut into chunks"):
        walk_forward(series, python_forecaster(lambda v: 0.0), 30, "expanding", block=16)
