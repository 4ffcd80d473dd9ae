from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tailgauge.operators import contracts as K
from tailgauge.operators import coverage as U
from tailgauge.operators import describe as D
from tailgauge.operators import exceptions as E
from tailgauge.operators import metrics as M
from tailgauge.operators import pairwise as P
from tailgauge.operators import regime as G

METHODS = ("historical_simulation", "ewma", "gradient_boosting")
SCHEMA = (
    "series_id string, method string, as_of date, target_date date, actual_return double, quantile_return double, "
    "var double, violation boolean"
)


def day(i):
    return date(2024, 1, 1) + timedelta(days=i)


def predictions(spark, flags):
    """flags: method -> string of 0/1 per session; a hit returns -0.03 against a quantile of -0.02."""
    n = len(next(iter(flags.values())))
    hits = [max(f[i] == "1" for f in flags.values()) for i in range(n)]
    rows = []
    for method, line in flags.items():
        for i, c in enumerate(line):
            actual = -0.03 if hits[i] else 0.01
            q = -0.02 if c == "1" else -0.05
            rows.append(("s", method, day(i), day(i + 1), actual, q, -q, actual < q))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def three(spark):
    return predictions(
        spark,
        {
            "historical_simulation": "1100010100",
            "ewma": "1000010001",
            "gradient_boosting": "1010010000",
        },
    ).cache()


def test_equality_is_no_violation(spark):
    df = spark.createDataFrame([("s", "m", -0.02, -0.02), ("s", "m", -0.0200001, -0.02)],
                               "series_id string, method string, actual_return double, quantile_return double")
    assert [r.violation for r in M.score_predictions(df).orderBy(F.desc("actual_return")).collect()] == [False, True]


def test_metrics_and_leaders(spark, three):
    runs = spark.createDataFrame([(m, 1.0, "c") for m in METHODS], "method string, total_runtime_seconds double, config_id string")
    metrics = M.final_metrics(three, runs)
    counts = {r.method: r.violation_count for r in metrics.collect()}
    assert counts == {"historical_simulation": 4, "ewma": 3, "gradient_boosting": 3}
    leaders = {r.method: r.calibration_leader for r in M.criterion_leaders(metrics).collect()}
    assert leaders == {"historical_simulation": False, "ewma": True, "gradient_boosting": True}
    assert K.validate_metrics(metrics).count() == 3
    with pytest.raises(ValueError, match="rate_mismatch"):
        K.validate_metrics(metrics.withColumn("violation_rate", F.col("violation_rate") + 0.01))
    with pytest.raises(ValueError, match="var_range"):
        K.validate_metrics(metrics.withColumn("maximum_var", F.col("average_var") - 0.01))
    assert {r.status for r in K.audit_metrics(three, metrics).collect()} == {"PASS"}


def test_transitions(spark):
    row = U.transition_counts(predictions(spark, {"ewma": "0110"})).first()
    assert (row.n00, row.n01, row.n10, row.n11) == (0, 1, 1, 1)


@pytest.mark.parametrize("line", ["0" * 20, "1" * 20, "01" * 10])
def test_coverage_tests_at_the_bounds(spark, line):
    row = U.conditional_coverage(predictions(spark, {"ewma": line})).first()
    assert row.lr_uc >= 0 and row.lr_ind >= 0 and 0 <= row.p_cc <= 1
    assert row.n00 + row.n01 + row.n10 + row.n11 == 19


def test_fold_subtotals(spark, three):
    folded = three.withColumnRenamed("method", "model").withColumn("fold", (F.dayofmonth("target_date") > 6).cast("string"))
    metrics = M.fold_metrics(folded)
    assert metrics.count() == 9 and M.fold_totals_disagree(metrics).isEmpty()
    wrong = metrics.withColumn("n_violations", F.when(F.col("fold") == "true", 9).otherwise(F.col("n_violations")))
    assert M.fold_totals_disagree(wrong).count() == 3


BREAKS = {
    "duplicate_keys": lambda d: d.unionByName(d.limit(1)),
    "not_finite": lambda d: d.withColumn("quantile_return", F.lit(float("nan"))),
    "origin_not_before_target": lambda d: d.withColumn("as_of", F.col("target_date")),
    "var_sign_or_value": lambda d: d.withColumn("var", F.col("quantile_return")),
    "violation_rule": lambda d: d.withColumn("violation", ~F.col("violation")),
    "return_domain": lambda d: d.withColumn("actual_return", F.lit(-1.0)),
    "unequal_universe": lambda d: d.filter((F.col("method") != "ewma") | (F.col("target_date") > day(1))),
    "unequal_actuals": lambda d: d.withColumn(
        "actual_return", F.when(F.col("method") == "ewma", F.col("actual_return") + 1e-6).otherwise(F.col("actual_return"))
    ),
}


@pytest.mark.parametrize("rule", sorted(BREAKS))
def test_each_contract_rule(three, rule):
    assert K.validate_predictions(three) is three
    with pytest.raises(ValueError, match=rule):
        K.validate_predictions(BREAKS[rule](three))


def test_clusters(spark):
    df = predictions(spark, {"ewma": "11100101", "historical_simulation": "00000000", "gradient_boosting": "00000000"})
    strict = sorted((r.length for r in E.strict_clusters(df).collect()), reverse=True)
    assert strict == [3, 1, 1]
    near = E.near_clusters(E.exception_matrix(df), gap=2).groupBy("cluster_id").count().orderBy("cluster_id").collect()
    assert [r["count"] for r in near] == [3, 2]


def test_categories_and_cases(three):
    matrix = E.exception_matrix(three)
    kinds = [r.exception_category for r in matrix.orderBy("target_date").collect()]
    assert kinds == ["shared_all_3", "historical_only", "gb_only", "no_violation", "no_violation", "shared_all_3",
                     "no_violation", "historical_only", "no_violation", "ewma_only"]
    cases = {r.case_type: r for r in E.severe_cases(matrix).collect()}
    assert len(cases) == 5 and cases["most_severe_shared"].target_date == day(1)
    absent = {r.case_type: r for r in E.severe_cases(matrix.filter(F.col("exception_category") != "gb_only")).collect()}
    assert absent["most_severe_gb_only"].exception_category == "not_available"
    overlap = E.exception_overlap(matrix).first()
    assert (overlap.both, overlap.left_only, overlap.right_only) == (2, 2, 1)
    studies = E.case_studies(E.two_model_frame(three)).orderBy("case_id").collect()
    assert [r.case_id for r in studies] == [f"C{i:02d}" for i in range(1, len(studies) + 1)]
    assert len({r.target_date for r in studies}) == len(studies)


def test_months_without_targets_are_present(spark):
    df = predictions(spark, {"ewma": "1" + "0" * 80}).filter(F.month("target_date") != 2)
    rows = {r.calendar_month: r for r in E.monthly_exceptions(df).collect()}
    assert rows["2024-02"].targets == 0 and rows["2024-02"].violation_rate is None and rows["2024-01"].violations == 1


def test_pairwise(three):
    diagnostics = P.pairwise_diagnostics(three)
    assert diagnostics.count() == 10
    rows = {r.comparison: r for r in P.pairwise_summary(diagnostics).collect()}
    for r in rows.values():
        assert r.left_better_count + r.right_better_count + r.tie_count == r.observation_count == 10
        assert r.net_total_delta == pytest.approx(r.gross_left_deterioration - r.gross_left_improvement)
    shares = P.top_k_share(diagnostics).first()
    assert 0 <= shares.top_1_improvement_share <= shares.top_5_improvement_share <= 1
    need = P.dates_to_fraction(diagnostics).first()
    assert need.improvement_dates_to_50pct <= need.improvement_dates_to_80pct
    assert "tie" in {r.lowest_pinball_method for r in diagnostics.collect()}


def test_no_gain_needs_no_dates(spark):
    df = predictions(spark, {m: "0000" for m in METHODS})
    row = P.dates_to_fraction(P.pairwise_diagnostics(df)).first()
    assert row.improvement_dates_to_50pct == 0
    assert P.top_k_share(P.pairwise_diagnostics(df)).first().top_20_improvement_share == 0.0


def test_regime_thresholds_come_from_history(spark, series):
    targets = series.filter("series_id = 'P'").orderBy("date").collect()[100:]
    rows = [("P", "ewma", r.date, r.date, r.ret, -0.02, 0.02, r.ret < -0.02) for r in targets]
    pred = spark.createDataFrame(rows, SCHEMA)
    a = G.volatility_regime(series, pred)
    cut = targets[0].date
    later = series.withColumn("ret", F.when(F.col("date") >= F.lit(cut), F.col("ret") * 4).otherwise(F.col("ret")))
    bounds = lambda d: d.select("low_vol_threshold", "high_vol_threshold").distinct().collect()
    assert bounds(a) == bounds(G.volatility_regime(later, pred)) and len(bounds(a)) == 1
    assert {r.regime for r in a.collect()} <= set(G.REGIMES)


def test_histogram_keeps_every_observation(spark, panel):
    from tailgauge.operators.returns import both_returns

    returns = both_returns(panel)
    for bins in (None, 5):
        rows = D.histogram(returns, bins=bins).groupBy("ticker").agg(F.sum("n").alias("n")).collect()
        assert {r.n for r in rows} == {39}


def test_correlation_of_a_column_with_itself_is_one(spark, panel):
    from tailgauge.operators.returns import return_matrix, simple_return

    wide = return_matrix(simple_return(panel), ["AAA", "BBB", "CCC"])
    rows = {(r.left, r.right): r.correlation for r in D.correlation_matrix(wide, ["AAA", "BBB", "CCC"]).collect()}
    assert len(rows) == 9 and rows["AAA", "AAA"] == 1.0 and rows["AAA", "BBB"] == rows["BBB", "AAA"]


def test_sections_have_each_row_once(spark, series):
    rows = D.sample_sections(series.filter("series_id = 'Q'"), 5).collect()
    assert len(rows) == 15
    short = D.sample_sections(series.filter("series_id = 'Q'").limit(7), 5).collect()
    assert len(short) == len({r.date for r in short}) == 7


@pytest.mark.parametrize("block, sessions", [(256, 4096), (3, 5), (1, 1)])
def test_correlation_by_blocks_equals_numpy(spark, block, sessions):
    import numpy as np
    from datetime import date, timedelta

    from tailgauge.operators.correlation import correlation_blocks

    rng = np.random.default_rng(5)
    values = rng.normal(size=(40, 8)) @ rng.normal(size=(8, 8))
    values[:, 7] = 1.5  # no variation
    names = [f"T{i}" for i in range(8)]
    rows = [(n, date(2020, 1, 1) + timedelta(days=d), float(values[d, i])) for i, n in enumerate(names) for d in range(40)]
    rows = [r for r in rows if r[:2] != ("T3", date(2020, 1, 9))] + [("T3", date(2020, 1, 9), None)]  # that session goes
    df = spark.createDataFrame(rows, "ticker string, date date, simple_return double").repartition(4)
    got = {(r.left, r.right): r.correlation for r in correlation_blocks(df, block=block, sessions=sessions).collect()}
    want = np.corrcoef(np.delete(values, 8, 0)[:, :7].T)
    assert len(got) == 64 and all(got[a, "T7"] is None and got["T7", a] is None for a in names)
    for i in range(7):
        for j in range(7):
            assert got[names[i], names[j]] == pytest.approx(want[i, j], abs=1e-12)
    with pytest.raises(ValueError, match="has 2 values"):
        correlation_blocks(df.unionByName(df.limit(1)))


def test_correlation_stores_no_pair_of_tickers(spark, monkeypatch):
    import os
    from datetime import date, timedelta

    import numpy as np

    from tailgauge.operators import correlation
    from tailgauge.session import shared_dir

    # strips of two blocks, so that most pairs of blocks are in different strips
    monkeypatch.setattr(correlation, "STRIP", 64)
    values = np.random.default_rng(6).normal(size=(4, 300))
    names = [f"T{i:03}" for i in range(300)]
    rows = [(n, date(2020, 1, 1) + timedelta(days=d), float(values[d, i])) for i, n in enumerate(names) for d in range(4)]
    df = spark.createDataFrame(rows, "ticker string, date date, simple_return double").repartition(2)

    def stored() -> int:
        return sum(os.path.getsize(os.path.join(top, f)) for top, _, files in os.walk(shared_dir(spark)) for f in files)

    before = stored()
    found = correlation.correlation_blocks(df, block=32).collect()
    assert stored() - before < 8 * 300 * 300 / 2  # half the pairs as doubles; each block is a small file
    got = np.full((300, 300), np.nan)
    for r in found:
        got[int(r.left[1:]), int(r.right[1:])] = r.correlation
    assert len(found) == 300 * 300 and np.allclose(got, np.corrcoef(values.T), atol=1e-12)


def test_mirrored_correlations_take_little_room_when_written(spark, monkeypatch, tmp_path):
    import os
    from datetime import date, timedelta

    import numpy as np

    from tailgauge.operators import correlation

    monkeypatch.setattr(correlation, "STRIP", 128)
    values = np.random.default_rng(7).normal(size=(5, 500))
    names = [f"T{i:03}" for i in range(500)]
    rows = [(n, date(2020, 1, 1) + timedelta(days=d), float(values[d, i])) for i, n in enumerate(names) for d in range(5)]
    df = spark.createDataFrame(rows, "ticker string, date date, simple_return double").repartition(2)
    found = correlation.correlation_blocks(df, block=32)
    # plain values and a codec, as in tables of more values than a dictionary has
    found.write.option("parquet.enable.dictionary", "false").option("compression", "snappy").parquet(f"{tmp_path}/whole")
    found.select("correlation").write.option("parquet.enable.dictionary", "false").option("compression", "snappy").parquet(f"{tmp_path}/values")
    size = sum(os.path.getsize(tmp_path / "values" / f) for f in os.listdir(tmp_path / "values"))
    assert size < 0.7 * 8 * 500 * 500
    got = np.full((500, 500), np.nan)
    stored = spark.read.parquet(f"{tmp_path}/whole").collect()
    for r in stored:
        got[int(r.left[1:]), int(r.right[1:])] = r.correlation
    assert len(stored) == 500 * 500 and np.allclose(got, np.corrcoef(values.T), atol=1e-12) and (got == got.T).all()
