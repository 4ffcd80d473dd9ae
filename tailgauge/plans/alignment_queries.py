"""Catalog: calendar alignment, validated joins and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as J
from ..operators.blocked import number_sessions
from ..operators.features import FEATURES_7, MARKET_FEATURES, feature_table_7f, market_feature_table
from ..operators.metrics import violation_metrics
from .catalog import query
from .features_queries import RELATIVE
from .fixtures import CUTOFF, TICKERS, Tables

OHLCV = "open high low close volume"


@query("align_calendars", "aligned", "SELECT ticker, date, close FROM aligned", "close")
def _(t: Tables):
    return t.aligned.select("ticker", "date", "close")


@query("align_calendars_derived_count", "aligned", "SELECT ticker, date, close FROM aligned", "close")
def _(t: Tables):
    return J.align_calendars(t.bars).select("ticker", "date", "close")


@query("calendar_mismatch", "bars", """
  SELECT date, count(*) AS tickers FROM bars WHERE volume > 500 GROUP BY 1 HAVING count(*) <> 3
""")
def _(t: Tables):
    return J.calendar_mismatch(t.bars.filter(F.col("volume") > 500), len(TICKERS))


@query("calendar_coverage", "bars", """
  WITH l AS (SELECT date FROM bars WHERE ticker = 'A'), r AS (SELECT date FROM bars WHERE ticker = 'R')
  SELECT count(*) FILTER (l.date IS NOT NULL AND r.date IS NOT NULL) AS common, count(*) FILTER (r.date IS NULL) AS
    left_only, count(*) FILTER (l.date IS NULL) AS right_only, min(l.date) FILTER (r.date IS NULL) AS first_left_only,
    min(r.date) FILTER (l.date IS NULL) AS first_right_only
  FROM l FULL JOIN r ON l.date = r.date
""")
def _(t: Tables):
    return J.calendar_coverage(t.bars.filter(F.col("ticker") == "A"), t.bars.filter(F.col("ticker") == "R"))


@query("enrich_many_to_one", "pred port", """
  SELECT p.series_id, p.method, p.target_date, p.violation, m.month_sessions FROM pred p JOIN (
    SELECT series_id, strftime(date, '%Y-%m') AS month, count(*) AS month_sessions FROM port GROUP BY 1, 2) m
  ON p.series_id = m.series_id AND strftime(p.target_date, '%Y-%m') = m.month
""")
def _(t: Tables):
    dim = t.portfolio.groupBy("series_id", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("month_sessions")
    )
    facts = t.predictions.withColumn("month", F.date_format("target_date", "yyyy-MM"))
    return J.enrich_many_to_one(facts, dim, ["series_id", "month"]).select(
        "series_id", "method", "target_date", "violation", "month_sessions"
    )


@query("merge_one_to_one", "pred", """
  SELECT a.series_id, a.target_date, a.var AS historical_var, b.var AS ewma_var FROM pred a JOIN pred b
    ON a.series_id = b.series_id AND a.target_date = b.target_date
  WHERE a.method = 'historical_simulation' AND b.method = 'ewma'
""", "historical_var ewma_var")
def _(t: Tables):
    def one(method: str, name: str):
        return t.predictions.filter(F.col("method") == method).select(
            "series_id", "target_date", F.col("var").alias(name)
        )

    return J.merge_one_to_one(
        one("historical_simulation", "historical_var"), one("ewma", "ewma_var"), ["series_id", "target_date"]
    )


@query("reindex_left", "idx bars", """
  SELECT c.date, m.close FROM (
    SELECT CAST(unnest(generate_series(min(date) - 7, max(date) + 7, INTERVAL 1 DAY)) AS DATE) AS date FROM bars) c
  LEFT JOIN idx m ON c.date = m.date
""", "close")
def _(t: Tables):
    """Every calendar day, a week beyond either end included."""
    span = t.bars.agg(F.date_sub(F.min("date"), 7).alias("first"), F.date_add(F.max("date"), 7).alias("last"))
    return J.reindex_left(span.select(F.explode(F.sequence("first", "last")).alias("date")), t.index).select("date", "close")


@query("merge_history", "bars", "SELECT ticker, date, open, high, low, close, volume FROM bars", OHLCV)
def _(t: Tables):
    return J.merge_history(t.old, t.new)


@query("revised_history", "newb oldb", f"""
  SELECT ticker, date, 'close' AS field, o.close AS old, n.close * 1.01e0 AS new FROM oldb o JOIN newb n
    USING (ticker, date) WHERE ticker = 'A' AND date <= DATE '{CUTOFF}'
""", "old new")
def _(t: Tables):
    return J.revised_rows(t.old, t.revised)


@query("previous_session", "port", """
  SELECT DISTINCT series_id, target_date, (SELECT max(date) FROM port c WHERE c.series_id = t.series_id
    AND c.date < t.target_date) AS as_of
  FROM (SELECT series_id, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS target_date FROM port) t
""")
def _(t: Tables):
    targets = t.portfolio.select(
        "series_id", F.add_months(F.trunc("date", "month"), 1).alias("target_date")
    ).distinct()
    return J.previous_session(targets, t.portfolio)


@query("previous_session_on_calendar", "port", """
  SELECT series_id, date AS target_date, lag(date) OVER (PARTITION BY series_id ORDER BY date) AS as_of FROM port
""")
def _(t: Tables):
    return J.previous_session_on_calendar(t.portfolio)


TASKS = """
  SELECT series_id, task, count(*) AS train_rows, min(target_date) AS train_start, max(target_date) AS train_end
  FROM folded, (SELECT CAST(unnest(range((SELECT greatest(1, (max(position) - 500) // 100 + 1) FROM folded))) AS INTEGER) AS task) WHERE position < 500 + task * 100 {extra} GROUP BY 1, 2
"""


def _training(t: Tables, rolling: int | None):
    numbered = number_sessions(t.features, ("series_id",), "target_date")
    last = numbered.agg(F.max("position")).first()[0]
    rows = J.training_rows(numbered, tasks=max(1, (last - 500) // 100 + 1), first_task_position=500, step=100, rolling=rolling)
    return rows.groupBy("series_id", "task").agg(
        F.count(F.lit(1)).alias("train_rows"), F.min("target_date").alias("train_start"),
        F.max("target_date").alias("train_end"),
    )


@query("training_rows_expanding", "folded", TASKS.format(extra=""))
def _(t: Tables):
    return _training(t, None)


@query("training_rows_rolling", "folded", TASKS.format(extra="AND position >= 500 + task * 100 - 250"))
def _(t: Tables):
    return _training(t, 250)


@query("pair_methods", "pred", """
  SELECT l.series_id, l.target_date, l.as_of AS left_as_of, l.actual_return AS left_actual_return,
    l.quantile_return AS left_quantile_return, l.var AS left_var, l.violation AS left_violation,
    r.as_of AS right_as_of, r.actual_return AS right_actual_return, r.quantile_return AS right_quantile_return,
    r.var AS right_var, r.violation AS right_violation
  FROM pred l JOIN pred r ON l.series_id = r.series_id AND l.target_date = r.target_date
  WHERE l.method = 'ewma' AND r.method = 'historical_simulation'
""", "left_actual_return left_quantile_return left_var right_actual_return right_quantile_return right_var")
def _(t: Tables):
    return J.pair_methods(t.predictions, "ewma", "historical_simulation")


@query("restrict_common_dates", "predw", """
  SELECT series_id, "window", date AS target_date, q FROM (
    SELECT series_id, 125 AS "window", date, q125 AS q FROM predw WHERE q250 IS NOT NULL
    UNION ALL SELECT series_id, 250, date, q250 FROM predw WHERE q250 IS NOT NULL)
""", "q")
def _(t: Tables):
    from ..models.historical import window_grid

    wide = window_grid(t.portfolio, {"125": 125, "250": 250})
    rows = F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"`{n}`").alias("q")) for n in (125, 250)])
    long = wide.select("series_id", F.col("date").alias("target_date"), F.inline(rows)).filter("q IS NOT NULL")
    return J.restrict_common_dates(long, "window")


@query("compare_reference", "pred", """
  SELECT series_id, method, count(*) AS n, CAST(0 AS BIGINT) AS unmatched, max(d) AS max_abs_difference,
    avg(d) AS mean_abs_difference, CASE WHEN max(d) > 1e-9 THEN 'MISMATCH' ELSE 'PASS' END AS status
  FROM (SELECT *, CASE WHEN method = 'ewma' AND day(target_date) = 13 THEN 1e-3 ELSE 0e0 END AS d FROM pred) GROUP BY 1, 2
""", "max_abs_difference mean_abs_difference", digits=10)
def _(t: Tables):
    from ..models.walk_forward import compare_methods

    again = compare_methods(t.portfolio, t.boosted, block=512)
    moved = (F.col("method") == "ewma") & (F.dayofmonth("target_date") == 13)
    again = again.withColumn("quantile_return", F.when(moved, F.col("quantile_return") + 1e-3).otherwise(F.col("quantile_return")))
    return J.compare_reference(
        t.predictions, again, ["series_id", "method", "target_date"], "quantile_return", ["series_id", "method"]
    )


@query("reconcile_metrics", "foldpred", """
  SELECT series_id, model, fold, 'both' AS side, 0e0 AS n_targets_abs_difference, 0e0 AS n_violations_abs_difference,
    0e0 AS violation_rate_abs_difference, CAST(0 AS BIGINT) AS errors, 'PASS' AS status
  FROM foldpred WHERE fold <> '5' GROUP BY 1, 2, 3
  UNION ALL SELECT series_id, model, fold, 'left_only', NULL, NULL, NULL, CAST(4 AS BIGINT), 'FAIL'
  FROM foldpred WHERE fold = '5' GROUP BY 1, 2, 3
""")
def _(t: Tables):
    keys = ["series_id", "model", "fold"]
    metrics = violation_metrics(t.fold_predictions, keys)
    other = violation_metrics(t.fold_predictions.filter(F.col("fold") != "5"), keys)
    return J.reconcile_metrics(metrics, other, keys, ["n_targets", "n_violations"], ["violation_rate"])


@query("join_feature_sets", "feat aligned idx", f"""
  WITH stocks AS (SELECT date, avg((high - low) / close) AS a, avg(vc) AS b, avg(rv) AS c FROM (
      SELECT *, volume / lag(volume) OVER (PARTITION BY ticker ORDER BY date) - 1 AS vc, {RELATIVE} AS rv FROM aligned
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY 1),
    moved AS (SELECT stocks.*, idx.close / lag(idx.close) OVER (ORDER BY stocks.date) - 1 AS r
      FROM stocks LEFT JOIN idx ON stocks.date = idx.date),
    market AS (SELECT date, lag(a) OVER o AS portfolio_range, lag(b) OVER o AS volume_change,
      lag(c) OVER o AS relative_volume_20, lag(r) OVER o AS market_return_lag_1, lag(r, 5) OVER o AS market_return_lag_5,
      CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS market_vol_20
      FROM moved WINDOW o AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT series_id, date AS target_date, {', '.join(FEATURES_7)}, {', '.join(MARKET_FEATURES)}, ret AS actual_return
  FROM feat JOIN market USING (date) WHERE rolling_vol_60 IS NOT NULL AND market_vol_20 IS NOT NULL
""", " ".join([*FEATURES_7, *MARKET_FEATURES, "actual_return"]))
def _(t: Tables):
    target = t.portfolio.select("series_id", F.col("date").alias("target_date"), F.col("ret").alias("actual_return"))
    return J.join_feature_sets(
        feature_table_7f(t.portfolio), market_feature_table(t.bars, t.index, len(TICKERS)), target
    )
