"""Catalog: forecasts, folds and next-session values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..models import folds as V
from ..models.ewma import decay_grid, ewma_path, ewma_var
from ..models.forecast import monetary_var, next_session_forecast
from ..models.historical import historical_var, rolling_historical_var, window_grid
from ..models.walk_forward import compare_methods, empirical_quantile, normal_moments, python_forecaster, walk_forward
from ..operators.metrics import fold_metrics, violation_metrics
from .catalog import query
from .fixtures import SPLIT, Tables

Z = "-1.6448536269514726e0"
OF_SERIES = "PARTITION BY series_id ORDER BY date"


@query("walk_forward_metrics", "predw", """
  SELECT series_id, count(*) AS forecast_count, count(*) FILTER (ret < q250) AS violation_count,
    count(*) FILTER (ret < q250) / count(*) AS violation_rate,
    avg(greatest(0.05 * (ret - q250), -0.95 * (ret - q250))) AS pinball_loss, avg(greatest(0, -q250)) AS average_var,
    min(date) AS test_start, max(date) AS test_end
  FROM predw WHERE q250 IS NOT NULL GROUP BY 1
""", "violation_rate pinball_loss average_var")
def _(t: Tables):
    forecasts = rolling_historical_var(t.portfolio, 250).select(
        "series_id", "target_date", F.col("target_return").alias("actual_return"), "quantile_return"
    )
    first = forecasts.groupBy("series_id").agg(
        F.min("target_date").alias("test_start"), F.max("target_date").alias("test_end")
    )
    return violation_metrics(forecasts, ("series_id",)).select(
        "series_id", F.col("n_targets").alias("forecast_count"), F.col("n_violations").alias("violation_count"),
        "violation_rate", F.col("mean_pinball_loss").alias("pinball_loss"), "average_var",
    ).join(first, "series_id")


@query("historical_var", "port", """
  SELECT *, greatest(0, -quantile_return) AS var FROM (SELECT series_id, count(ret) AS observations,
    quantile_cont(ret, 0.05) AS quantile_return FROM port GROUP BY 1)
""", "quantile_return var")
def _(t: Tables):
    return historical_var(t.portfolio)


ROLLING = """
  SELECT series_id, s AS window_start_date, e AS window_end_date, e AS forecast_date, date AS target_date,
    n AS observations, q AS quantile_return, greatest(0, -q) AS historical_var, ret AS target_return
  FROM (SELECT *, min(date) OVER w AS s, max(date) OVER w AS e, count(ret) OVER w AS n, quantile_cont(ret, 0.05) OVER w AS q
    FROM port WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) WHERE n = 250
"""


@query("rolling_historical_var", "port", ROLLING, "quantile_return historical_var target_return")
def _(t: Tables):
    return rolling_historical_var(t.portfolio, 250)


@query("rolling_historical_var_blocked", "port", ROLLING, "quantile_return historical_var target_return")
def _(t: Tables):
    return rolling_historical_var(t.portfolio, 250, block=512)


@query("ewma_var", "ewma", f"""
  SELECT series_id, n AS observations, date AS forecast_date, v AS variance, {Z} * sqrt(v) AS quantile_return,
    greatest(0, 1.6448536269514726e0 * sqrt(v)) AS var
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ewma) WHERE i = n - 1
""", "variance quantile_return var")
def _(t: Tables):
    return ewma_var(t.portfolio)


@query("ewma_path", "ewma", f"SELECT series_id, date, ret, {Z} * sqrt(v_before) AS quantile_return FROM ewma",
       "ret quantile_return")
def _(t: Tables):
    return ewma_path(t.portfolio)


@query("walk_forward_rolling", "port", f"""
  SELECT series_id, e AS as_of, s AS train_start, n AS train_rows, date AS target_date, ret AS actual_return,
    q AS quantile_return, greatest(0, -q) AS var, ret < q AS violation
  FROM (SELECT *, min(date) OVER w AS s, max(date) OVER w AS e, count(ret) OVER w AS n,
      quantile_cont(ret, 0.05) OVER w AS q
    FROM port WINDOW w AS ({OF_SERIES} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) WHERE n >= 100
""", "actual_return quantile_return var")
def _(t: Tables):
    return walk_forward(t.portfolio, empirical_quantile(), 100, "rolling", block=512)


@query("walk_forward_expanding", "port", f"""
  SELECT series_id, e AS as_of, s AS train_start, n AS train_rows, date AS target_date, ret AS actual_return,
    q AS quantile_return, greatest(0, -q) AS var, ret < q AS violation
  FROM (SELECT *, min(date) OVER w AS s, max(date) OVER w AS e, count(ret) OVER w AS n,
      avg(ret) OVER w + {Z} * stddev_samp(ret) OVER w AS q
    FROM port WINDOW w AS ({OF_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 250
""", "actual_return quantile_return var")
def _(t: Tables):
    return walk_forward(t.portfolio, normal_moments(), 250, "expanding")


@query("walk_forward_expanding_quantile", "port", f"""
  SELECT series_id, e AS as_of, s AS train_start, n AS train_rows, date AS target_date, ret AS actual_return,
    q AS quantile_return, greatest(0, -q) AS var, ret < q AS violation
  FROM (SELECT *, min(date) OVER w AS s, max(date) OVER w AS e, count(ret) OVER w AS n, quantile_cont(ret, 0.05) OVER w AS q
    FROM port WINDOW w AS ({OF_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n >= 250
""", "actual_return quantile_return var")
def _(t: Tables):
    return walk_forward(t.portfolio, empirical_quantile(), 250, "expanding", block=256)


@query("walk_forward_python", "port", f"""
  SELECT series_id, e AS as_of, s AS train_start, n AS train_rows, date AS target_date, ret AS actual_return,
    q AS quantile_return, greatest(0, -q) AS var, ret < q AS violation
  FROM (SELECT *, min(date) OVER w AS s, max(date) OVER w AS e, count(ret) OVER w AS n, quantile_cont(ret, 0.1) OVER w AS q
    FROM port WINDOW w AS ({OF_SERIES} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) WHERE n >= 60
""", "actual_return quantile_return var")
def _(t: Tables):
    return walk_forward(t.portfolio, python_forecaster(lambda values: values.quantile(0.1)), 60, "rolling", block=512)


@query("method_predictions", "pred", "SELECT * FROM pred", "actual_return quantile_return var")
def _(t: Tables):
    return compare_methods(t.portfolio, t.boosted)


@query("method_predictions_blocked", "pred", "SELECT * FROM pred", "actual_return quantile_return var")
def _(t: Tables):
    return compare_methods(t.portfolio, t.boosted, block=512)


@query("expanding_folds", "folded", """
  SELECT series_id, target_date, position, fold FROM folded
""")
def _(t: Tables):
    return V.expanding_folds(t.features).select("series_id", "target_date", "position", "fold")


@query("fold_plan", "folded", """
  WITH f AS (SELECT unnest([1, 2, 3, 4, 5]) AS k)
  SELECT series_id, CAST(k AS INTEGER) AS fold, count(*) FILTER (fold < k) AS train_rows,
    min(target_date) FILTER (fold < k) AS train_start, max(target_date) FILTER (fold < k) AS train_end,
    count(*) FILTER (fold = k) AS valid_rows, min(target_date) FILTER (fold = k) AS valid_start,
    max(target_date) FILTER (fold = k) AS valid_end
  FROM folded, f GROUP BY 1, 2
""")
def _(t: Tables):
    return V.fold_plan(V.expanding_folds(t.features))


@query("dev_holdout_split", "feat12", f"""
  SELECT series_id, CASE WHEN target_date <= DATE '{SPLIT}' THEN 'development' ELSE 'holdout' END AS part,
    count(*) AS rows, min(target_date) AS first_target, max(target_date) AS last_target FROM feat12 GROUP BY 1, 2
""")
def _(t: Tables):
    split = V.dev_holdout_split(t.features, date.fromisoformat(SPLIT))
    return split.groupBy("series_id", "part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("target_date").alias("first_target"),
        F.max("target_date").alias("last_target"),
    )


@query("cv_predictions_baselines", "foldpred", """
  SELECT series_id, model, fold, as_of, target_date, actual_return, quantile_return, var, violation FROM foldpred
""", "actual_return quantile_return var")
def _(t: Tables):
    return t.fold_predictions


CV = """SELECT series_id, method AS model, fold, avg(greatest(0.05 * (actual_return - quantile_return),
  -0.95 * (actual_return - quantile_return))) AS loss FROM foldpred GROUP BY 1, 2, 3"""


@query("cv_ranking", "foldpred", f"""
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cv_mean_loss, model) AS rank FROM (
    SELECT series_id, model, avg(loss) AS cv_mean_loss, count(*) AS folds FROM ({CV}) GROUP BY 1, 2)
""", "cv_mean_loss")
def _(t: Tables):
    metrics = fold_metrics(t.fold_predictions)
    return V.cv_ranking(metrics.filter(F.col("fold") != "all_validation"))


@query("cv_best_candidate", "foldpred", f"""
  SELECT series_id, model, avg(loss) AS cv_mean_loss, count(*) AS folds FROM ({CV}) WHERE starts_with(model, 'h')
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY avg(loss), model) = 1
""", "cv_mean_loss")
def _(t: Tables):
    metrics = fold_metrics(t.fold_predictions)
    return V.cv_ranking(metrics.filter(F.col("fold") != "all_validation"), prefix="h")


@query("window_sensitivity", "port", """
  WITH q AS (SELECT *, quantile_cont(ret, 0.05) OVER a AS q125, quantile_cont(ret, 0.05) OVER b AS q250,
      quantile_cont(ret, 0.05) OVER c AS q500, count(ret) OVER c AS n FROM port
    WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING),
      b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING),
      c AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING)),
    m AS (SELECT series_id, 125 AS "window", ret, q125 AS q FROM q WHERE n = 500 UNION ALL SELECT series_id, 250, ret, q250 FROM q
      WHERE n = 500 UNION ALL SELECT series_id, 500, ret, q500 FROM q WHERE n = 500),
    s AS (SELECT series_id, "window", count(*) AS n_targets, count(*) FILTER (ret < q) AS n_violations,
      count(*) FILTER (ret < q) / count(*) AS violation_rate, avg(greatest(0.05 * (ret - q), -0.95 * (ret - q))) AS
      mean_pinball_loss, avg(greatest(0, -q)) AS average_var FROM m GROUP BY 1, 2)
  SELECT s.*, s.mean_pinball_loss - b.mean_pinball_loss AS loss_vs_baseline FROM s JOIN s b
    ON s.series_id = b.series_id AND b."window" = 250
""", "violation_rate mean_pinball_loss average_var loss_vs_baseline")
def _(t: Tables):
    wide = window_grid(t.portfolio, {"125": 125, "250": 250, "500": 500}).dropna()
    rows = F.array(
        *[F.struct(F.lit(n).alias("window"), F.col(f"`{n}`").alias("quantile_return")) for n in (125, 250, 500)]
    )
    long = wide.select("series_id", F.col("ret").alias("actual_return"), F.inline(rows))
    metrics = violation_metrics(long, ("series_id", "window"))
    base = metrics.filter(F.col("window") == 250).select("series_id", F.col("mean_pinball_loss").alias("_base"))
    return metrics.join(base, "series_id").withColumn(
        "loss_vs_baseline", F.col("mean_pinball_loss") - F.col("_base")
    ).drop("_base")


def _decay_sql(decay: str) -> str:
    return f"""SELECT {decay} AS decay, series_id, ret, {Z} * sqrt(lag(v) OVER (PARTITION BY series_id ORDER BY i)) AS q, i
      FROM (SELECT *, pow({decay}, i) * sum(x * pow({decay}, -i)) OVER (PARTITION BY series_id ORDER BY i) AS v FROM (
        SELECT *, CASE WHEN i = 0 THEN ret * ret ELSE (1 - {decay}) * ret * ret END AS x FROM (
          SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM port)))"""


@query("decay_sensitivity", "port", f"""
  SELECT decay, series_id, count(*) AS n_targets, count(*) FILTER (ret < q) AS n_violations,
    count(*) FILTER (ret < q) / count(*) AS violation_rate, avg(greatest(0.05 * (ret - q), -0.95 * (ret - q))) AS
    mean_pinball_loss, avg(greatest(0, -q)) AS average_var
  FROM ({_decay_sql('90e-2')} UNION ALL {_decay_sql('94e-2')} UNION ALL {_decay_sql('97e-2')}) WHERE q IS NOT NULL
  GROUP BY 1, 2
""", "decay violation_rate mean_pinball_loss average_var")
def _(t: Tables):
    paths = decay_grid(t.portfolio, [0.90, 0.94, 0.97]).filter(F.col("quantile_return").isNotNull())
    return violation_metrics(paths.withColumnRenamed("ret", "actual_return"), ("decay", "series_id"))


NEXT = f"""
  SELECT series_id, 'historical_simulation' AS method, max(date) AS as_of, quantile_cont(ret, 0.05) AS quantile_return,
    greatest(0, -quantile_cont(ret, 0.05)) AS var
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM port) WHERE k <= 250
  GROUP BY 1 HAVING count(*) = 250
  UNION ALL
  SELECT series_id, 'ewma', date, {Z} * sqrt(v), greatest(0, 1.6448536269514726e0 * sqrt(v))
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ewma) WHERE i = n - 1
"""


@query("next_session_forecast", "ewma", NEXT, "quantile_return var")
def _(t: Tables):
    return next_session_forecast(t.portfolio)


@query("monetary_var", "ewma", f"SELECT *, var * 1000000 AS monetary_var FROM ({NEXT})",
       "quantile_return var monetary_var", digits=4)
def _(t: Tables):
    return monetary_var(next_session_forecast(t.portfolio), 1_000_000)
