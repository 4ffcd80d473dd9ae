"""Catalog: returns and portfolio construction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import returns as R
from .catalog import query
from .fixtures import TICKERS, Tables


@query("simple_return", "bars", """
  SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS simple_return FROM bars
""", "close simple_return")
def _(t: Tables):
    return R.simple_return(t.bars).select("ticker", "date", "close", "simple_return")


@query("log_return", "bars", """
  SELECT ticker, date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS log_return FROM bars
""", "log_return")
def _(t: Tables):
    return R.log_return(t.bars).select("ticker", "date", "log_return")


@query("equal_weights", "bars", """
  SELECT 'ALL' AS portfolio_id, ticker, 1e0 / count(*) OVER () AS weight FROM (SELECT DISTINCT ticker FROM bars)
  UNION ALL SELECT DISTINCT ticker, ticker, 1e0 FROM bars
""", "weight")
def _(t: Tables):
    return R.equal_weights(t.bars.select(F.explode(F.array(F.lit("ALL"), "ticker")).alias("portfolio_id"), "ticker"))


@query("validate_weights", "bars", """
  SELECT portfolio_id, count(*) AS tickers, count(*) FILTER (NOT isfinite(weight)) AS not_finite,
    count(*) FILTER (weight < 0) AS negative, CAST(0 AS BIGINT) AS repeated, sum(weight) AS weight_sum,
    abs(sum(weight) - 1) <= 1e-12 AND count(*) FILTER (weight < 0) = 0 AS valid
  FROM (SELECT 'volume' AS portfolio_id, ticker, sum(volume) / sum(sum(volume)) OVER () AS weight FROM bars GROUP BY ticker
    UNION ALL SELECT 'doubled', ticker, 2e0 * sum(volume) / sum(sum(volume)) OVER () FROM bars GROUP BY ticker
    UNION ALL SELECT 'short', ticker, -1e0 * sum(volume) / sum(sum(volume)) OVER () FROM bars GROUP BY ticker)
  GROUP BY 1
""", "weight_sum")
def _(t: Tables):
    volume = t.bars.groupBy("ticker").agg(F.sum("volume").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(1)))
    kinds = F.array(
        F.struct(F.lit("volume").alias("portfolio_id"), share.alias("weight")),
        F.struct(F.lit("doubled").alias("portfolio_id"), (2.0 * share).alias("weight")),
        F.struct(F.lit("short").alias("portfolio_id"), (-1.0 * share).alias("weight")),
    )
    return R.validate_weights(volume.select("ticker", kinds.alias("_k")).select("ticker", F.inline("_k")))


@query("portfolio_return", "rets weights", """
  SELECT portfolio_id, date, sum(weight * simple_return) AS portfolio_simple_return, true AS complete
  FROM rets JOIN weights USING (ticker) GROUP BY 1, 2
""", "portfolio_simple_return")
def _(t: Tables):
    return R.portfolio_return(t.returns, t.weights)


@query("portfolio_log_return", "port", """
  SELECT series_id, date, ret, ln(1 + ret) AS portfolio_log_return FROM port
""", "ret portfolio_log_return")
def _(t: Tables):
    return R.portfolio_log_return(t.portfolio, "ret")


@query("build_portfolio", "rets", """
  SELECT date, avg(simple_return) AS portfolio_simple_return, ln(1 + avg(simple_return)) AS portfolio_log_return
  FROM rets GROUP BY 1
""", "portfolio_simple_return portfolio_log_return")
def _(t: Tables):
    return R.build_portfolio(t.aligned, len(TICKERS))


@query("return_identity", "rets", """
  SELECT ticker, count(log_return) AS valid, max(abs(log_return - ln(1 + simple_return))) AS max_abs_difference,
    avg(abs(log_return - ln(1 + simple_return))) AS mean_abs_difference,
    count(*) FILTER (abs(log_return - ln(1 + simple_return)) > 1e-9) AS offenders FROM rets GROUP BY 1
""", "max_abs_difference mean_abs_difference")
def _(t: Tables):
    return R.return_identity(t.returns, 1e-9)


@query("jensen_gap", "rets weights", """
  SELECT portfolio_id, count(gap) AS comparisons, min(gap) AS minimum_gap, max(gap) AS maximum_gap, avg(gap) AS mean_gap,
    count(*) FILTER (gap < -1e-9) AS negative_gaps, count(*) FILTER (abs(gap) <= 1e-9) AS near_zero_gaps,
    first(date ORDER BY round(gap, 12) + 0 DESC, date) AS maximum_gap_date
  FROM (SELECT portfolio_id, date, ln(1 + sum(weight * simple_return)) - sum(weight * log_return) AS gap
    FROM rets JOIN weights USING (ticker) GROUP BY 1, 2) GROUP BY 1
""", "minimum_gap maximum_gap mean_gap")
def _(t: Tables):
    return R.jensen_gap(t.returns, t.weights, 1e-9)


@query("return_matrix", "bars", """
  WITH r AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars)
  SELECT date, "A", "N", "R", "A" IS NOT NULL AND "N" IS NOT NULL AND "R" IS NOT NULL AS complete FROM (
    SELECT date, max(r) FILTER (ticker = 'A') AS "A", max(r) FILTER (ticker = 'N') AS "N",
      max(r) FILTER (ticker = 'R') AS "R" FROM r GROUP BY 1)
""", "A N R")
def _(t: Tables):
    return R.return_matrix(R.simple_return(t.bars), TICKERS)


@query("normalized_price", "aligned", """
  SELECT ticker, date, close / first(close) OVER (PARTITION BY ticker ORDER BY date) * 100 AS normalized_close
  FROM aligned
""", "normalized_close")
def _(t: Tables):
    return R.normalized_price(t.aligned)


@query("performance_summary", "bars", """
  SELECT *, (last_close / first_close - 1) * 100 AS change_pct FROM (
    SELECT ticker, min(date) AS first_date, max(date) AS last_date, arg_min(close, date) AS first_close,
      arg_max(close, date) AS last_close FROM bars GROUP BY 1)
""", "first_close last_close change_pct")
def _(t: Tables):
    return R.performance_summary(t.bars)


DRAWDOWN = """
  SELECT series_id, date, s AS log_wealth, greatest(0, m) AS log_peak, exp(s - greatest(0, m)) - 1 AS drawdown FROM (
    SELECT *, max(s) OVER (PARTITION BY series_id ORDER BY date) AS m FROM (
      SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY series_id ORDER BY date) AS s FROM port))
"""


@query("wealth_drawdown", "port", DRAWDOWN, "log_wealth log_peak drawdown")
def _(t: Tables):
    return R.wealth_drawdown(t.portfolio)


@query("drawdown_trough", "port", f"""
  SELECT series_id, min(drawdown) AS max_drawdown, count(*) AS sessions FROM ({DRAWDOWN}) GROUP BY 1
""", "max_drawdown")
def _(t: Tables):
    run = R.wealth_drawdown(t.portfolio)
    sizes = run.groupBy("series_id").agg(F.count(F.lit(1)).alias("sessions"))
    return R.drawdown_trough(run).drop("trough_date").join(sizes, "series_id")


@query("price_drawdown", "bars", """
  SELECT ticker, date, close / max(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS drawdown FROM bars
""", "drawdown")
def _(t: Tables):
    return R.price_drawdown(t.bars)


@query("return_rebuild_check", "port", """
  SELECT series_id, count(*) AS sessions, count(*) FILTER (day(date) = 27) AS unmatched,
    count(*) FILTER (day(date) = 13) AS offenders FROM port GROUP BY 1
""")
def _(t: Tables):
    """Stored returns of which one day a month is off and one is lost."""
    stored = t.portfolio.filter(F.dayofmonth("date") != 27).withColumn(
        "ret", F.when(F.dayofmonth("date") == 13, F.col("ret") + 1e-6).otherwise(F.col("ret"))
    )
    return R.return_rebuild_check(t.bars, t.weights, stored, len(TICKERS), 1e-9)
