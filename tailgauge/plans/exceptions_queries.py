"""Catalog: exceptions, regimes and pairwise comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exceptions as E
from ..operators import pairwise as P
from ..operators import regime as G
from ..operators.metrics import final_metrics
from .catalog import query
from .fixtures import Tables
from .metrics_queries import runs

MATRIX = """series_id, target_date, historical_violation, ewma_violation, gb_violation, actual_return,
  violation_method_count, exception_category, calendar_month"""


@query("exception_matrix", "matrixc", f"SELECT {MATRIX} FROM matrixc", "actual_return")
def _(t: Tables):
    return E.exception_matrix(t.predictions)


@query("classify_exception", "two", "SELECT series_id, exception_type, count(*) AS sessions FROM two GROUP BY 1, 2")
def _(t: Tables):
    return E.two_model_frame(t.predictions).groupBy("series_id", "exception_type").agg(
        F.count(F.lit(1)).alias("sessions")
    )


@query("near_clusters", "near", f"SELECT {MATRIX}, target_position, cluster_id FROM near", "actual_return")
def _(t: Tables):
    return E.near_clusters(E.exception_matrix(t.predictions))


@query("strict_clusters", "runs", "SELECT * FROM runs", "max_exceedance")
def _(t: Tables):
    return E.strict_clusters(t.predictions)


@query("cluster_summary", "runs", """
  SELECT series_id, method, count(*) AS clusters, count(*) FILTER (length = 1) AS singletons,
    count(*) FILTER (length > 1) AS multi_observation, max(length) AS max_length,
    CAST(sum(length) AS BIGINT) AS exceptions FROM runs GROUP BY 1, 2
""")
def _(t: Tables):
    return E.cluster_summary(E.strict_clusters(t.predictions))


@query("cluster_length_histogram", "runs", """
  SELECT series_id, method, length, count(*) AS clusters FROM runs GROUP BY 1, 2, 3
""")
def _(t: Tables):
    return E.cluster_length_histogram(E.strict_clusters(t.predictions))


@query("largest_clusters", "runs", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, method ORDER BY length DESC, max_exceedance DESC,
    cluster_start) AS rank FROM runs) WHERE rank <= 10
""", "max_exceedance")
def _(t: Tables):
    return E.largest_clusters(E.strict_clusters(t.predictions))


@query("exception_timing", "matrixc", """
  SELECT series_id, calendar_month, count(*) AS exception_dates,
    CAST(sum(violation_method_count) AS BIGINT) AS method_level_violations
  FROM matrixc WHERE violation_method_count > 0 GROUP BY 1, 2
""")
def _(t: Tables):
    return E.monthly_timing(E.exception_matrix(t.predictions))


CLUSTERS = """
  SELECT series_id, cluster_id, min(target_date) AS cluster_start, max(target_date) AS cluster_end,
    count(*) AS exception_dates, CAST(sum(violation_method_count) AS BIGINT) AS method_level_violations,
    min(actual_return) AS minimum_actual_return FROM near GROUP BY 1, 2
"""


@query("cluster_timing", "near", CLUSTERS, "minimum_actual_return")
def _(t: Tables):
    return E.cluster_timing(E.near_clusters(E.exception_matrix(t.predictions)))


@query("severe_cases", "matrixc near", f"""
  WITH s AS (SELECT DISTINCT series_id FROM matrixc), k AS (SELECT unnest(['shared_all_3', 'historical_only', 'ewma_only',
      'gb_only']) AS category, unnest(['most_severe_shared', 'most_severe_historical_only', 'most_severe_ewma_only',
      'most_severe_gb_only']) AS case_type),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, exception_category ORDER BY actual_return,
      target_date) AS rn FROM matrixc) WHERE rn = 1),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY method_level_violations DESC,
      exception_dates DESC, minimum_actual_return, cluster_start) AS rn FROM ({CLUSTERS})) WHERE rn = 1)
  SELECT s.series_id, case_type, target_date, actual_return,
    CASE WHEN b.series_id IS NULL THEN 'not_available' ELSE category END AS exception_category,
    CAST(NULL AS DATE) AS cluster_start, CAST(NULL AS DATE) AS cluster_end, CAST(NULL AS BIGINT) AS exception_dates,
    CAST(NULL AS BIGINT) AS method_level_violations
  FROM s CROSS JOIN k LEFT JOIN b ON b.series_id = s.series_id AND b.exception_category = category
  UNION ALL SELECT series_id, 'largest_multi_method_cluster', NULL, minimum_actual_return, 'cluster', cluster_start,
    cluster_end, exception_dates, method_level_violations FROM c
""", "actual_return")
def _(t: Tables):
    return E.severe_cases(E.exception_matrix(t.predictions))


@query("monthly_exceptions", "pred", """
  WITH c AS (SELECT series_id, method, date_trunc('month', target_date) AS m, count(*) AS targets,
      count(*) FILTER (violation) AS violations FROM pred GROUP BY 1, 2, 3),
    spine AS (SELECT series_id, method, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM c GROUP BY 1, 2)
  SELECT s.series_id, s.method, strftime(s.m, '%Y-%m') AS calendar_month, coalesce(targets, 0) AS targets,
    coalesce(violations, 0) AS violations, violations / targets AS violation_rate
  FROM spine s LEFT JOIN c ON s.series_id = c.series_id AND s.method = c.method AND s.m = c.m
""", "violation_rate")
def _(t: Tables):
    return E.monthly_exceptions(t.predictions)


@query("quantile_timeline", "diag", """
  SELECT series_id, target_date, actual_return, historical_quantile_return AS historical_quantile,
    ewma_quantile_return AS ewma_quantile, gb_quantile_return AS gb_quantile FROM diag
""", "actual_return historical_quantile ewma_quantile gb_quantile")
def _(t: Tables):
    return E.quantile_timeline(t.predictions)


@query("exception_overlap", "two", """
  SELECT *, "both" / union_count AS jaccard, "both" / ("both" + left_only) AS share_of_left,
    "both" / ("both" + right_only) AS share_of_right FROM (
    SELECT series_id, count(*) FILTER (exception_type = 'both') AS "both",
      count(*) FILTER (exception_type = 'historical_only') AS left_only,
      count(*) FILTER (exception_type = 'ewma_only') AS right_only,
      count(*) FILTER (exception_type <> 'none') AS union_count FROM two GROUP BY 1)
""", "jaccard share_of_left share_of_right")
def _(t: Tables):
    return E.exception_overlap(E.exception_matrix(t.predictions))


@query("exceedance_severity", "pred", """
  SELECT series_id, method, count(*) AS violations, avg(e) AS mean_exceedance, quantile_cont(e, 0.5) AS median_exceedance,
    quantile_cont(e, 0.25) AS q25_exceedance, quantile_cont(e, 0.75) AS q75_exceedance,
    quantile_cont(e, 0.9) AS q90_exceedance, max(e) AS max_exceedance
  FROM (SELECT *, quantile_return - actual_return AS e FROM pred WHERE violation) GROUP BY 1, 2
""", "mean_exceedance median_exceedance q25_exceedance q75_exceedance q90_exceedance max_exceedance")
def _(t: Tables):
    return E.exceedance_severity(t.predictions)


@query("worst_exceedances", "pred", """
  SELECT series_id, method, rank, target_date, actual_return, quantile_return, exceedance FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, method ORDER BY exceedance DESC, target_date) AS rank FROM (
      SELECT *, quantile_return - actual_return AS exceedance FROM pred WHERE violation)) WHERE rank <= 10
""", "actual_return quantile_return exceedance")
def _(t: Tables):
    return E.worst_exceedances(t.predictions)


CASES = """
  WITH e AS (SELECT *, CASE exception_type WHEN 'both' THEN greatest(historical_exceedance, ewma_exceedance)
      WHEN 'historical_only' THEN historical_exceedance ELSE ewma_exceedance END AS s,
      CASE exception_type WHEN 'both' THEN 2 ELSE 1 END AS quota, CASE exception_type WHEN 'both' THEN 'top_shared_severity'
      WHEN 'historical_only' THEN 'top_historical_only_severity' ELSE 'top_ewma_only_severity' END AS reason
      FROM two WHERE exception_type <> 'none'),
    tops AS (SELECT series_id, target_date, reason FROM (SELECT *, row_number() OVER (PARTITION BY series_id,
      exception_type ORDER BY s DESC, target_date) AS rn FROM e) WHERE rn <= quota),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY series_id ORDER BY target_date) AS run FROM (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY target_date) AS p FROM two) WHERE historical_violation),
    best AS (SELECT series_id, run FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, worst DESC, a)
      AS rn FROM (SELECT series_id, run, count(*) AS n, max(historical_exceedance) AS worst, min(target_date) AS a FROM r
        GROUP BY 1, 2)) WHERE rn = 1),
    chosen AS (SELECT series_id, target_date, min(reason) AS selection_reason FROM (SELECT * FROM tops UNION ALL
      SELECT r.series_id, target_date, 'longest_historical_exception_cluster' FROM r JOIN best ON r.series_id =
        best.series_id AND r.run = best.run) GROUP BY 1, 2),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY target_date) AS k FROM chosen)
  SELECT printf('C%02d', k) AS case_id, n.series_id, n.target_date, selection_reason, exception_type, actual_return,
    historical_violation, historical_var, historical_exceedance, ewma_violation, ewma_var, ewma_exceedance
  FROM numbered n JOIN two ON n.series_id = two.series_id AND n.target_date = two.target_date WHERE k <= 10
"""
CASE_DOUBLES = "actual_return historical_var historical_exceedance ewma_var ewma_exceedance"


@query("case_studies", "two", CASES, CASE_DOUBLES)
def _(t: Tables):
    return E.case_studies(E.two_model_frame(t.predictions))


@query("shock_response", "pred", """
  SELECT series_id, method, count(*) FILTER (top AND change > 1e-15) AS increases,
    count(*) FILTER (top AND abs(change) <= 1e-15) AS unchanged, count(*) FILTER (top AND change < -1e-15) AS decreases,
    avg(change) FILTER (top) AS mean_change, quantile_cont(change, 0.5) FILTER (top) AS median_change,
    max(change) FILTER (top) AS max_increase, corr(size, change) AS correlation
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id, method ORDER BY size DESC, target_date) <= 20 AS top FROM (
    SELECT *, abs(actual_return) AS size, lead(var) OVER (PARTITION BY series_id, method ORDER BY target_date) - var AS
      change FROM (SELECT * REPLACE (round(var, 12) AS var) FROM pred)) WHERE change IS NOT NULL) GROUP BY 1, 2
""", "mean_change median_change max_increase correlation", digits=7)
def _(t: Tables):
    return E.shock_response(t.predictions.withColumn("var", F.round("var", 12)))


@query("episode", "pred two", f"""
  SELECT pred.* FROM pred JOIN (SELECT series_id, min(target_date) - INTERVAL 15 DAY AS a, max(target_date) + INTERVAL 15 DAY
    AS b FROM ({CASES}) GROUP BY 1) s ON pred.series_id = s.series_id AND target_date BETWEEN a AND b
""", "actual_return quantile_return var")
def _(t: Tables):
    return E.episode(t.predictions, E.case_studies(E.two_model_frame(t.predictions)))


@query("volatility_regime", "regimes", """
  SELECT series_id, method, target_date, prior_vol, low_vol_threshold, high_vol_threshold, regime FROM regimes
""", "prior_vol low_vol_threshold high_vol_threshold")
def _(t: Tables):
    return G.volatility_regime(t.portfolio, t.predictions).select(
        "series_id", "method", "target_date", "prior_vol", "low_vol_threshold", "high_vol_threshold", "regime"
    )


@query("regime_metrics", "regimes", """
  SELECT series_id, regime, method, count(*) AS observations, count(*) FILTER (violation) AS violation_count,
    count(*) FILTER (violation) / count(*) AS violation_rate, avg(greatest(0.05 * (actual_return - quantile_return),
    -0.95 * (actual_return - quantile_return))) AS pinball_loss, avg(var) AS average_var,
    avg(actual_return) AS average_actual_return, abs(count(*) FILTER (violation) / count(*) - 0.05e0) AS calibration_distance
  FROM regimes GROUP BY 1, 2, 3
""", "violation_rate pinball_loss average_var average_actual_return calibration_distance")
def _(t: Tables):
    return G.regime_metrics(G.volatility_regime(t.portfolio, t.predictions))


@query("regime_pivot", "regimes", """
  SELECT series_id, regime, CAST(CASE regime WHEN 'LOW' THEN 1 WHEN 'NORMAL' THEN 2 ELSE 3 END AS BIGINT) AS regime_order,
    avg(CAST(violation AS INTEGER)) FILTER (method = 'historical_simulation') AS historical_simulation,
    avg(CAST(violation AS INTEGER)) FILTER (method = 'ewma') AS ewma,
    avg(CAST(violation AS INTEGER)) FILTER (method = 'gradient_boosting') AS gradient_boosting FROM regimes GROUP BY 1, 2
""", "historical_simulation ewma gradient_boosting")
def _(t: Tables):
    metrics = G.regime_metrics(G.volatility_regime(t.portfolio, t.predictions))
    return G.regime_pivot(metrics, ["historical_simulation", "ewma", "gradient_boosting"])


DIAGNOSTICS = """
  SELECT * EXCLUDE (ties), CASE WHEN ties > 1 THEN 'tie' WHEN historical_pinball_loss - lowest_pinball_loss <= 1e-15 THEN
    'historical_simulation' WHEN ewma_pinball_loss - lowest_pinball_loss <= 1e-15 THEN 'ewma' ELSE 'gradient_boosting' END
    AS lowest_pinball_method
  FROM (SELECT *, CAST(historical_pinball_loss - lowest_pinball_loss <= 1e-15 AS INTEGER)
      + CAST(ewma_pinball_loss - lowest_pinball_loss <= 1e-15 AS INTEGER)
      + CAST(gb_pinball_loss - lowest_pinball_loss <= 1e-15 AS INTEGER) AS ties
    FROM (SELECT d.*, m.historical_violation, m.ewma_violation, m.gb_violation,
      gb_var - historical_var AS gb_minus_historical_var, gb_var - ewma_var AS gb_minus_ewma_var,
      ewma_var - historical_var AS ewma_minus_historical_var,
      abs(gb_quantile_return - historical_quantile_return) AS abs_gb_historical_quantile_diff,
      abs(gb_quantile_return - ewma_quantile_return) AS abs_gb_ewma_quantile_diff,
      abs(ewma_quantile_return - historical_quantile_return) AS abs_ewma_historical_quantile_diff,
      least(historical_pinball_loss, ewma_pinball_loss, gb_pinball_loss) AS lowest_pinball_loss
    FROM diag d JOIN matrix m USING (series_id, target_date)))
"""
PREFIXES = ("historical", "ewma", "gb")
DIAGNOSTIC_DOUBLES = " ".join(
    ["actual_return", "lowest_pinball_loss"]
    + [f"{p}_{c}" for p in PREFIXES for c in ("quantile_return", "var", "pinball_loss")]
    + [f"{a}_minus_{b}_{c}" for a, b in P.PAIRS for c in ("pinball", "var")]
    + [f"abs_{a}_{b}_quantile_diff" for a, b in P.PAIRS]
)


@query("pairwise_diagnostics", "diag matrix", DIAGNOSTICS, DIAGNOSTIC_DOUBLES)
def _(t: Tables):
    return P.pairwise_diagnostics(t.predictions)


@query("pairwise_reconcile", "deltas", """
  SELECT series_id, comparison, avg(delta) AS mean_delta, avg(delta) AS metric_delta, true AS reconciled
  FROM deltas GROUP BY 1, 2
""", "mean_delta metric_delta")
def _(t: Tables):
    return P.pairwise_reconcile(P.pairwise_diagnostics(t.predictions), final_metrics(t.predictions, runs(t)), 1e-10)


@query("pairwise_summary", "deltas", """
  SELECT series_id, comparison, count(*) AS observation_count, count(*) FILTER (delta < -1e-15) AS left_better_count,
    count(*) FILTER (delta > 1e-15) AS right_better_count, count(*) FILTER (abs(delta) <= 1e-15) AS tie_count,
    count(*) FILTER (delta < -1e-15) / count(*) AS left_better_share, avg(delta) AS mean_delta,
    quantile_cont(delta, 0.5) AS median_delta, avg(abs(delta)) AS mean_absolute_delta, sum(gain) AS gross_left_improvement,
    sum(CASE WHEN delta > 1e-15 THEN delta ELSE 0 END) AS gross_left_deterioration, sum(delta) AS net_total_delta,
    max(gain) AS largest_left_improvement, first(target_date ORDER BY delta, target_date) AS largest_left_improvement_date,
    max(CASE WHEN delta > 1e-15 THEN delta ELSE 0 END) AS largest_left_deterioration,
    first(target_date ORDER BY delta DESC, target_date) AS largest_left_deterioration_date
  FROM deltas GROUP BY 1, 2
""", """left_better_share mean_delta median_delta mean_absolute_delta gross_left_improvement gross_left_deterioration
  net_total_delta largest_left_improvement largest_left_deterioration""", digits=7)
def _(t: Tables):
    return P.pairwise_summary(P.pairwise_diagnostics(t.predictions))


@query("top_k_share", "deltas", """
  SELECT series_id, comparison, """ + ", ".join(
    f"coalesce(sum(gain) FILTER (rn <= {k}) / sum(gain), 0) AS top_{k}_improvement_share" for k in (1, 5, 10, 20)
) + """ FROM (SELECT *, row_number() OVER (PARTITION BY series_id, comparison ORDER BY gain DESC, target_date) AS rn
    FROM deltas) GROUP BY 1, 2
""", " ".join(f"top_{k}_improvement_share" for k in (1, 5, 10, 20)))
def _(t: Tables):
    return P.top_k_share(P.pairwise_diagnostics(t.predictions))


@query("dates_to_fraction", "deltas", """
  SELECT series_id, comparison,
    coalesce(min(rn) FILTER (gain > 1e-15 AND c >= 5e-1 * s), 0) AS improvement_dates_to_50pct,
    coalesce(min(rn) FILTER (gain > 1e-15 AND c >= 8e-1 * s), 0) AS improvement_dates_to_80pct
  FROM (SELECT *, row_number() OVER w AS rn, sum(gain) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
    sum(gain) OVER (PARTITION BY series_id, comparison) AS s FROM deltas
    WINDOW w AS (PARTITION BY series_id, comparison ORDER BY gain DESC, target_date)) GROUP BY 1, 2
""")
def _(t: Tables):
    return P.dates_to_fraction(P.pairwise_diagnostics(t.predictions))
