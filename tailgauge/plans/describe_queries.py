"""Catalog: descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe as D
from ..operators.correlation import correlation_blocks
from ..operators.returns import both_returns, return_matrix
from .catalog import query
from .fixtures import TICKERS, Tables


@query("panel_overview", "bars", """
  SELECT ticker, count(*) AS rows, min(date) AS start_date, max(date) AS end_date, count(*) FILTER (close IS NULL) AS
    missing_close FROM bars GROUP BY 1
""")
def _(t: Tables):
    return D.panel_overview(t.bars)


@query("return_moments", "rets", """
  SELECT ticker, count(log_return) AS observations, avg(log_return) AS mean, median(log_return) AS median,
    stddev_samp(log_return) AS std, min(log_return) AS minimum, max(log_return) AS maximum,
    skewness(log_return) AS skewness, kurtosis(log_return) AS excess_kurtosis FROM rets GROUP BY 1
""", "mean median std minimum maximum skewness excess_kurtosis", digits=7)
def _(t: Tables):
    return D.return_moments(t.returns)


@query("return_quantiles", "rets", "SELECT ticker, " + ", ".join(
    f"quantile_cont(log_return, {q}) AS {n}" for n, q in D.TAILS.items()) + " FROM rets GROUP BY 1", " ".join(D.TAILS))
def _(t: Tables):
    return D.return_quantiles(t.returns)


@query("zero_return_share", "rets", """
  SELECT ticker, count(r) AS observations, count(*) FILTER (r = 0) AS zero_days, count(*) FILTER (r = 0) / count(r) AS
    zero_share FROM (SELECT ticker, round(simple_return, 2) AS r FROM rets) GROUP BY 1
""", "zero_share")
def _(t: Tables):
    return D.zero_return_share(t.returns.withColumn("simple_return", F.round("simple_return", 2)))


@query("return_sign_table", "rets", """
  SELECT ticker, count(*) FILTER (r < 0) AS negative_days, count(*) FILTER (r = 0) AS zero_days,
    count(*) FILTER (r > 0) AS positive_days, count(*) FILTER (r < 0) / count(r) AS negative_share,
    count(*) FILTER (r = 0) / count(r) AS zero_share, count(*) FILTER (r > 0) / count(r) AS positive_share
  FROM (SELECT ticker, round(simple_return, 2) AS r FROM rets) GROUP BY 1
""", "negative_share zero_share positive_share")
def _(t: Tables):
    return D.return_sign_table(t.returns.withColumn("simple_return", F.round("simple_return", 2)))


FENCES = """SELECT *, q25 - 1.5 * (q75 - q25) AS lower_fence, q75 + 1.5 * (q75 - q25) AS upper_fence FROM (
  SELECT ticker, quantile_cont(log_return, 0.25) AS q25, quantile_cont(log_return, 0.75) AS q75 FROM rets GROUP BY 1)"""


@query("iqr_outliers", "rets", f"""
  SELECT r.ticker, date, log_return, abs(log_return) AS absolute_return, lower_fence, upper_fence FROM rets r JOIN ({FENCES}) f
    ON r.ticker = f.ticker WHERE log_return < lower_fence OR log_return > upper_fence
""", "log_return absolute_return lower_fence upper_fence")
def _(t: Tables):
    return D.iqr_outliers(t.returns)


@query("iqr_outlier_summary", "rets", f"""
  SELECT r.ticker, q25, q75, lower_fence, upper_fence, count(*) AS observations, min(log_return) AS minimum_return,
    arg_min(date, log_return) AS minimum_date, max(log_return) AS maximum_return, arg_max(date, log_return) AS maximum_date,
    count(*) FILTER (log_return < lower_fence OR log_return > upper_fence) AS iqr_outlier_rows
  FROM rets r JOIN ({FENCES}) f ON r.ticker = f.ticker GROUP BY 1, 2, 3, 4, 5
""", "q25 q75 lower_fence upper_fence minimum_return maximum_return")
def _(t: Tables):
    return D.iqr_outlier_summary(t.returns)


@query("correlation_matrix", "rets port", """
  WITH m AS (SELECT ticker, date, simple_return AS r FROM rets UNION ALL SELECT 'ALL', date, ret FROM port WHERE series_id = 'ALL')
  SELECT a.ticker AS "left", b.ticker AS "right", CASE WHEN a.ticker = b.ticker THEN 1 ELSE corr(a.r, b.r) END AS correlation
  FROM m a JOIN m b ON a.date = b.date GROUP BY 1, 2
""", "correlation")
def _(t: Tables):
    whole = t.portfolio.filter(F.col("series_id") == "ALL").select("date", F.col("ret").alias("ALL"))
    wide = return_matrix(t.returns, TICKERS).join(whole, "date")
    return D.correlation_matrix(wide, [*TICKERS, "ALL"])


@query("correlation_blocks", "", """
  WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS s, date_trunc('quarter', CAST(l_shipdate AS DATE)) AS d,
      avg(l_extendedprice / l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    whole AS (SELECT d FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT s) FROM m)),
    c AS (SELECT * FROM m JOIN whole USING (d))
  SELECT a.s AS "left", b.s AS "right", CASE WHEN a.s = b.s THEN 1 ELSE corr(a.v, b.v) END AS correlation
  FROM c a JOIN c b ON a.d = b.d GROUP BY 1, 2
""", "correlation")
def _(t: Tables):
    """Every pair of suppliers by their mean unit price in each quarter."""
    prices = t.source("lineitem").groupBy("l_suppkey", F.trunc(F.to_date("l_shipdate"), "quarter").alias("date")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price")
    )
    return correlation_blocks(prices.withColumn("ticker", F.col("l_suppkey").cast("string")), value="price", block=32)


@query("rolling_vol_summary", "bars", """
  WITH r AS (SELECT ticker, date, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM bars),
    v AS (SELECT ticker, date, 20 AS "window", CASE WHEN count(r) OVER a = 20 THEN stddev_samp(r) OVER a END AS vol FROM r
        WINDOW a AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
      UNION ALL SELECT ticker, date, 60, CASE WHEN count(r) OVER b = 60 THEN stddev_samp(r) OVER b END FROM r
        WINDOW b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
  SELECT ticker, "window", count(vol) AS valid, count(*) FILTER (vol IS NULL) AS missing, avg(vol) AS mean_vol,
    quantile_cont(vol, 0.5) AS median_vol, max(vol) AS max_vol, arg_max(date, vol) AS max_vol_date FROM v GROUP BY 1, 2
""", "mean_vol median_vol max_vol")
def _(t: Tables):
    return D.rolling_vol_summary(both_returns(t.bars))


@query("left_tail", "rets", """
  SELECT ticker, count(*) AS left_tail_rows, min(date) AS earliest_tail_date, max(date) AS latest_tail_date,
    min(log_return) * 100 AS worst_tail_return_pct
  FROM (SELECT *, quantile_cont(log_return, 0.05) OVER (PARTITION BY ticker) AS cut FROM rets) WHERE log_return <= cut
  GROUP BY 1
""", "worst_tail_return_pct", digits=6)
def _(t: Tables):
    return D.left_tail(t.returns)


SHAPE = """SELECT ticker, min(log_return) AS lo, max(log_return) AS hi, count(*) AS n, quantile_cont(log_return, 0.75)
  - quantile_cont(log_return, 0.25) AS iqr FROM rets GROUP BY 1"""


def _histogram(bins: str) -> str:
    return f"""
      SELECT ticker, bins, bin, lo + bin * (hi - lo) / bins AS left_edge, count(*) AS n FROM (
        SELECT r.ticker, s.bins, lo, hi, least(CAST(floor((log_return - lo) * s.bins / (hi - lo)) AS BIGINT), s.bins - 1) AS bin
        FROM rets r JOIN (SELECT *, {bins} AS bins FROM ({SHAPE})) s ON r.ticker = s.ticker) GROUP BY ticker, bins, bin, lo, hi
    """


@query("histogram_freedman_diaconis", "rets",
       _histogram("CAST(ceil((hi - lo) / (2 * iqr / pow(n, 1e0 / 3))) AS BIGINT)"), "left_edge")
def _(t: Tables):
    return D.histogram(t.returns)


@query("histogram_fixed_bins", "rets", _histogram("CAST(60 AS BIGINT)"), "left_edge")
def _(t: Tables):
    return D.histogram(t.returns, bins=60)


@query("stock_kpis", "bars", """
  WITH p AS (SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM bars) WHERE date >= last - INTERVAL 1
      YEAR), r AS (SELECT *, close / lag(close) OVER w - 1 AS r, close / max(close) OVER w - 1 AS dd FROM p
      WINDOW w AS (PARTITION BY ticker ORDER BY date))
  SELECT ticker, arg_max(close, date) AS latest_close, arg_max(close, date) / arg_min(close, date) - 1 AS period_return,
    stddev_samp(r) * sqrt(252) AS annualized_volatility, min(dd) AS max_drawdown, max(r) AS best_day, min(r) AS worst_day,
    count(*) FILTER (r > 0) / count(r) AS positive_day_ratio FROM r GROUP BY 1
""", "latest_close period_return annualized_volatility max_drawdown best_day worst_day positive_day_ratio", digits=7)
def _(t: Tables):
    return D.stock_kpis(t.bars, "1Y")


@query("sample_sections", "port", """
  SELECT series_id, date, ret, p AS position FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS p,
    count(*) OVER (PARTITION BY series_id) AS n FROM port)
  WHERE p < 5 OR p >= n - 5 OR (p >= n // 2 - 2 AND p < n // 2 - 2 + 5)
""", "ret")
def _(t: Tables):
    return D.sample_sections(t.portfolio, 5)
