"""Catalog: scores, metric tables, coverage tests and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators import coverage as U
from ..operators import metrics as M
from .catalog import query
from .fixtures import Tables

# Runtime and configuration label of each method.
RUNS = [("historical_simulation", 1.5, "hs-250"), ("ewma", 0.5, "ewma-094"), ("gradient_boosting", 2.5, "hs-125")]
RUNS_SQL = "(VALUES ('historical_simulation',1.5e0,'hs-250'),('ewma',5e-1,'ewma-094'),('gradient_boosting',2.5e0,'hs-125'))"


def runs(t: Tables):
    return t.spark.createDataFrame(RUNS, "method string, total_runtime_seconds double, config_id string")


SUMMARY = """count(*) AS n_targets, count(*) FILTER (violation) AS n_violations,
  count(*) FILTER (violation) / count(*) AS violation_rate, avg(loss) AS mean_pinball_loss, avg(var) AS average_var"""
SUMMARY_DOUBLES = "violation_rate mean_pinball_loss average_var"


@query("score_predictions", "scored", """
  SELECT series_id, method, target_date, actual_return, quantile_return, var, violation, loss AS pinball_loss FROM scored
""", "actual_return quantile_return var pinball_loss")
def _(t: Tables):
    bare = t.predictions.select("series_id", "method", "target_date", "actual_return", "quantile_return")
    return M.score_predictions(bare)


@query("violation_metrics", "scored", f"SELECT series_id, method, {SUMMARY} FROM scored GROUP BY 1, 2", SUMMARY_DOUBLES)
def _(t: Tables):
    return M.violation_metrics(t.predictions)


FOLD_LOSS = """greatest(0.05 * (actual_return - quantile_return), -0.95 * (actual_return - quantile_return)) AS loss"""
FOLDS = f"""
  SELECT series_id, model, coalesce(fold, 'all_validation') AS fold, min(target_date) AS first_target,
    max(target_date) AS last_target, {SUMMARY}
  FROM (SELECT *, {FOLD_LOSS} FROM foldpred) GROUP BY GROUPING SETS ((series_id, model, fold), (series_id, model))
"""


@query("fold_metrics", "foldpred", FOLDS, SUMMARY_DOUBLES)
def _(t: Tables):
    return M.fold_metrics(t.fold_predictions)


@query("cv_aggregate", "foldpred", f"""
  SELECT series_id, model, CAST(sum(n_targets) AS BIGINT) AS n_targets, CAST(sum(n_violations) AS BIGINT) AS n_violations,
    avg(mean_pinball_loss) AS mean_pinball_loss, sum(n_violations) / sum(n_targets) AS violation_rate
  FROM ({FOLDS}) WHERE fold <> 'all_validation' GROUP BY 1, 2
""", "mean_pinball_loss violation_rate")
def _(t: Tables):
    return M.cv_aggregate(M.fold_metrics(t.fold_predictions))


METRIC_DOUBLES = "violation_rate pinball_loss average_var minimum_var maximum_var"


@query("final_metrics", "metrics", f"""
  SELECT metrics.*, total_runtime_seconds, config_id FROM metrics JOIN {RUNS_SQL} r(method, total_runtime_seconds, config_id)
    USING (method)
""", METRIC_DOUBLES)
def _(t: Tables):
    return M.final_metrics(t.predictions, runs(t))


@query("criterion_leaders", "metrics", """
  SELECT series_id, method, violation_rate, calibration_distance, pinball_loss, average_var,
    calibration_distance - min(calibration_distance) OVER w <= 1e-15 AS calibration_leader,
    pinball_loss - min(pinball_loss) OVER w <= 1e-15 AS pinball_leader,
    average_var - min(average_var) OVER w <= 1e-15 AS lowest_average_var
  FROM (SELECT *, abs(violation_rate - 0.05e0) AS calibration_distance FROM metrics) WINDOW w AS (PARTITION BY series_id)
""", "violation_rate calibration_distance pinball_loss average_var")
def _(t: Tables):
    return M.criterion_leaders(M.final_metrics(t.predictions, runs(t)))


@query("model_comparison", "metrics", """
  SELECT series_id, method, forecast_count, violation_count, violation_rate, pinball_loss, average_var FROM metrics
""", "violation_rate pinball_loss average_var")
def _(t: Tables):
    return M.model_comparison(M.final_metrics(t.predictions, runs(t)))


@query("exception_table", "pred", """
  SELECT series_id, target_date, method, actual_return, quantile_return, var FROM pred WHERE violation
""", "actual_return quantile_return var")
def _(t: Tables):
    return M.exception_table(t.predictions)


@query("latest_var", "pred", """
  SELECT series_id, method, target_date, actual_return, quantile_return, var, violation FROM (
    SELECT *, max(target_date) OVER (PARTITION BY series_id, method) AS last FROM pred) WHERE target_date = last
""", "actual_return quantile_return var")
def _(t: Tables):
    return M.latest_var(t.predictions)


@query("report_summary", "metrics", """
  SELECT series_id, method, forecast_count, printf('%.2f%%', violation_rate * 100) AS violation_rate_text FROM metrics
""")
def _(t: Tables):
    return M.report_summary(M.final_metrics(t.predictions, runs(t)))


@query("forecast_sanity", "pred", """
  WITH s AS (SELECT series_id, method, count(*) AS prediction_count, count(*) FILTER (violation) AS violation_count,
      min(quantile_return) AS quantile_min, max(quantile_return) AS quantile_max, avg(quantile_return) AS quantile_mean,
      quantile_cont(quantile_return, 0.5) AS quantile_median, quantile_cont(quantile_return, 0.05) AS quantile_p05,
      quantile_cont(quantile_return, 0.95) AS quantile_p95, min(var) AS var_min, max(var) AS var_max,
      quantile_cont(quantile_return, 0.25) AS q1, quantile_cont(quantile_return, 0.75) AS q3 FROM pred GROUP BY 1, 2)
  SELECT s.* EXCLUDE (q1, q3), (SELECT count(*) FROM pred p WHERE p.series_id = s.series_id AND p.method = s.method AND
    (p.quantile_return < q1 - 3 * (q3 - q1) OR p.quantile_return > q3 + 3 * (q3 - q1))) AS outlier_count FROM s
""", "quantile_min quantile_max quantile_mean quantile_median quantile_p05 quantile_p95 var_min var_max")
def _(t: Tables):
    return M.forecast_sanity(t.predictions)


@query("var_level_summary", "pred", """
  SELECT series_id, method, avg(var) AS mean_var, quantile_cont(var, 0.5) AS median_var, stddev_samp(var) AS std_var,
    quantile_cont(var, 0.25) AS q25_var, quantile_cont(var, 0.75) AS q75_var, min(var) AS min_var, max(var) AS max_var,
    first(target_date ORDER BY var, target_date) AS min_var_date,
    first(target_date ORDER BY var DESC, target_date) AS max_var_date
  FROM (SELECT * REPLACE (round(var, 12) AS var) FROM pred) GROUP BY 1, 2
""", "mean_var median_var std_var q25_var q75_var min_var max_var")
def _(t: Tables):
    return M.var_level_summary(t.predictions.withColumn("var", F.round("var", 12)))


@query("var_neighborhood", "pred", """
  WITH n AS (SELECT *, row_number() OVER w - 1 AS p, var - lag(var) OVER w AS change FROM (
      SELECT * REPLACE (round(var, 12) AS var) FROM pred)
      WINDOW w AS (PARTITION BY series_id, method ORDER BY target_date)),
    c AS (SELECT series_id, method, 'minimum' AS extreme, first(p ORDER BY var, p) AS c FROM n GROUP BY 1, 2
      UNION ALL SELECT series_id, method, 'maximum', first(p ORDER BY var DESC, p) FROM n GROUP BY 1, 2)
  SELECT n.series_id, n.method, extreme, target_date, p - c AS "offset", var,
    CASE WHEN p > greatest(c - 5, 0) THEN change END AS var_change, actual_return
  FROM n JOIN c ON n.series_id = c.series_id AND n.method = c.method AND abs(p - c) <= 5
""", "var var_change actual_return")
def _(t: Tables):
    return M.var_neighborhood(t.predictions.withColumn("var", F.round("var", 12)))


@query("paired_loss_comparison", "scored", """
  SELECT *, baseline_loss - candidate_loss AS paired_loss_improvement,
    100 * (baseline_loss - candidate_loss) / baseline_loss AS relative_loss_improvement_pct FROM (
    SELECT a.series_id, count(*) AS n_common, avg(a.loss) AS baseline_loss, avg(b.loss) AS candidate_loss,
      count(*) FILTER (a.violation) AS baseline_violations, count(*) FILTER (b.violation) AS candidate_violations
    FROM scored a JOIN scored b ON a.series_id = b.series_id AND a.target_date = b.target_date
    WHERE a.method = 'historical_simulation' AND b.method = 'ewma' GROUP BY 1)
""", "baseline_loss candidate_loss paired_loss_improvement relative_loss_improvement_pct")
def _(t: Tables):
    return M.paired_loss_comparison(t.predictions, "historical_simulation", "ewma")


def tail(x: str) -> str:
    """Upper tail of chi-square(1) at a statistic, as SQL folds over constant lists."""
    return f"""(SELECT CASE WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 80),
      lambda n: pow(2, n) * pow(z, 2 * n + 1) / list_reduce([1e0] || [2e0 * k + 3 for k in range(0, n)], lambda a, b: a * b)))
      ELSE exp(-z * z) / (sqrt(pi()) * list_reduce([z] || [CAST(k AS DOUBLE) for k in range(80, 0, -1)],
        lambda a, k: z + (k / 2) / a)) END FROM (SELECT sqrt({x} / 2) AS z))"""


LOGS = """CASE WHEN x = 0 THEN 0 ELSE x * ln({p}) END + CASE WHEN x = n THEN 0 ELSE (n - x) * ln(1 - {p}) END"""
KUPIEC = f"""
  SELECT series_id, method, n AS n_targets, x AS n_violations, x / n AS violation_rate, n * 0.05e0 AS expected_violations,
    n * 0.95e0 AS expected_nonviolations, x = 0 OR x = n AS boundary_observation, lr AS kupiec_lr, {tail('lr')} AS
    kupiec_p_value FROM (SELECT *, greatest(0, 2 * (({LOGS.format(p='(x / n)')}) - ({LOGS.format(p='0.05e0')}))) AS lr FROM (
      SELECT series_id, method, count(*) AS n, count(*) FILTER (violation) AS x FROM pred GROUP BY 1, 2))
"""
KUPIEC_FULL = f"""SELECT *, kupiec_p_value < 0.05 AS kupiec_reject, CASE WHEN kupiec_p_value < 0.05 THEN 'reject_H0' ELSE
  'do_not_reject_H0' END AS kupiec_decision FROM ({KUPIEC})"""


@query("kupiec_uc", "pred", KUPIEC_FULL,
       "violation_rate expected_violations expected_nonviolations kupiec_lr kupiec_p_value")
def _(t: Tables):
    return U.kupiec_uc(t.predictions)


CHRISTOFFERSEN = f"""
  SELECT *, {tail('lr_ind')} AS p_ind FROM (
    SELECT series_id, method, n00, n01, n10, n11, greatest(0, 2 * (
      CASE WHEN n01 = 0 THEN 0 ELSE n01 * ln(n01 / (n00 + n01)) END + CASE WHEN n00 = 0 THEN 0 ELSE n00 * ln(n00 / (n00 + n01)) END
      + CASE WHEN n11 = 0 THEN 0 ELSE n11 * ln(n11 / (n10 + n11)) END + CASE WHEN n10 = 0 THEN 0 ELSE n10 * ln(n10 / (n10 + n11)) END
      - CASE WHEN n01 + n11 = 0 THEN 0 ELSE (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11)) END
      - CASE WHEN n00 + n10 = 0 THEN 0 ELSE (n00 + n10) * ln((n00 + n10) / (n00 + n01 + n10 + n11)) END)) AS lr_ind
    FROM (SELECT series_id, method, count(*) FILTER (NOT a AND NOT b) AS n00, count(*) FILTER (NOT a AND b) AS n01,
      count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (a AND b) AS n11 FROM (
        SELECT series_id, method, violation AS b, lag(violation) OVER (PARTITION BY series_id, method ORDER BY target_date)
          AS a FROM pred) WHERE a IS NOT NULL GROUP BY 1, 2))
"""


@query("christoffersen_ind", "pred", CHRISTOFFERSEN, "lr_ind p_ind")
def _(t: Tables):
    return U.christoffersen_ind(t.predictions)


@query("conditional_coverage", "pred", f"""
  SELECT k.series_id, k.method, n_targets, n_violations, violation_rate, kupiec_lr AS lr_uc, kupiec_p_value AS p_uc, n00, n01,
    n10, n11, lr_ind, p_ind, kupiec_lr + lr_ind AS lr_cc, exp(-(kupiec_lr + lr_ind) / 2) AS p_cc
  FROM ({KUPIEC}) k JOIN ({CHRISTOFFERSEN}) c ON k.series_id = c.series_id AND k.method = c.method
""", "violation_rate lr_uc p_uc lr_ind p_ind lr_cc p_cc")
def _(t: Tables):
    return U.conditional_coverage(t.predictions)


@query("backtest_summary", "scored", f"""
  SELECT k.*, mean_pinball_loss, average_var, 0.05e0 AS quantile_alpha, 0.95e0 AS nominal_coverage,
    1 - k.violation_rate AS coverage
  FROM ({KUPIEC_FULL}) k JOIN (SELECT series_id, method, avg(loss) AS mean_pinball_loss, avg(var) AS average_var
    FROM scored GROUP BY 1, 2) s ON k.series_id = s.series_id AND k.method = s.method
""", """violation_rate expected_violations expected_nonviolations kupiec_lr kupiec_p_value mean_pinball_loss average_var
  quantile_alpha nominal_coverage coverage""")
def _(t: Tables):
    return U.backtest_summary(t.predictions)


ZEROS = ", ".join(f"CAST(0 AS BIGINT) AS {r}" for r in K.PREDICTION_RULES)


@query("validate_predictions", "pred", f"SELECT series_id, count(*) AS rows, {ZEROS} FROM pred GROUP BY 1")
def _(t: Tables):
    return K.prediction_violations(K.validate_predictions(t.predictions))


def _kind(k: int) -> str:
    return f"count(*) FILTER (k = {k} AND method = 'ewma')"


@query("prediction_violations_found", "pred", f"""
  SELECT series_id, count(*) + {_kind(0)} AS rows, {_kind(0)} AS duplicate_keys, {_kind(1)} AS not_finite,
    {_kind(2)} AS origin_not_before_target, {_kind(1)} + {_kind(3)} AS var_sign_or_value, {_kind(4)} AS violation_rule,
    CAST(0 AS BIGINT) AS return_domain, CAST(0 AS BIGINT) AS unequal_universe, CAST(0 AS BIGINT) AS unequal_actuals
  FROM (SELECT *, day(target_date) % 10 AS k FROM pred) GROUP BY 1
""")
def _(t: Tables):
    k = F.dayofmonth("target_date") % 10
    own = F.col("method") == "ewma"
    broken = t.predictions.withColumns(
        {
            "as_of": F.when(own & (k == 2), F.col("target_date")).otherwise(F.col("as_of")),
            "var": F.when(own & (k == 1), F.lit(None)).when(own & (k == 3), F.col("var") + 0.5).otherwise(F.col("var")),
            "violation": F.when(own & (k == 4), ~F.col("violation")).otherwise(F.col("violation")),
        }
    )
    return K.prediction_violations(broken.unionByName(broken.filter(own & (k == 0))))


@query("validate_metrics", "metrics", """
  SELECT series_id, count(*) AS methods, CAST(0 AS BIGINT) AS duplicate_methods, CAST(0 AS BIGINT) AS bad_counts,
    CAST(0 AS BIGINT) AS rate_mismatch, CAST(0 AS BIGINT) AS var_range, CAST(0 AS BIGINT) AS not_finite
  FROM metrics GROUP BY 1
""")
def _(t: Tables):
    return K.metric_violations(K.validate_metrics(M.final_metrics(t.predictions, runs(t))))


@query("audit_metrics", "metrics", """
  SELECT series_id, method, 'both' AS side, 0e0 AS forecast_count_abs_difference,
    CASE method WHEN 'ewma' THEN 1e0 ELSE 0e0 END AS violation_count_abs_difference, 0e0 AS violation_rate_abs_difference,
    0e0 AS pinball_loss_abs_difference, 0e0 AS average_var_abs_difference,
    CAST(CASE method WHEN 'ewma' THEN 1 ELSE 0 END AS BIGINT) AS errors,
    CASE method WHEN 'ewma' THEN 'FAIL' ELSE 'PASS' END AS status FROM metrics
""")
def _(t: Tables):
    reported = M.final_metrics(t.predictions, runs(t)).withColumn(
        "violation_count", F.col("violation_count") + (F.col("method") == "ewma").cast("int")
    )
    return K.audit_metrics(t.predictions, reported)


@query("normalize_predictions", "foldpred", """
  SELECT series_id, model, fold, as_of, target_date, actual_return, quantile_return, var AS var_return, violation,
    'b' AS source, 'expanding' AS protocol FROM foldpred
""", "actual_return quantile_return var_return")
def _(t: Tables):
    foreign = t.fold_predictions.select(
        "series_id", F.concat(F.lit(" "), "model", F.lit(" ")).alias("model"), "fold", "as_of", "target_date",
        "actual_return", "quantile_return",
    )
    return K.normalize_predictions(foreign, "b", "expanding")
