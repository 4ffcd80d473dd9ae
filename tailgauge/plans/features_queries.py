"""Catalog: lagged features and other window columns."""

from __future__ import annotations


from ..operators import features as X
from .catalog import query
from .fixtures import TICKERS, Tables

BLOCK = 512


@query("return_lags", "feat", "SELECT series_id, date, ret, return_lag_1, return_lag_2, return_lag_5 FROM feat",
       "ret return_lag_1 return_lag_2 return_lag_5")
def _(t: Tables):
    return X.return_lags(t.portfolio)


@query("rolling_vol", "feat", "SELECT series_id, date, rolling_vol_5, rolling_vol_20, rolling_vol_60 FROM feat",
       "rolling_vol_5 rolling_vol_20 rolling_vol_60")
def _(t: Tables):
    return X.rolling_vol(t.portfolio).drop("ret")


@query("lagged_drawdown", "feat", "SELECT series_id, date, drawdown FROM feat", "drawdown")
def _(t: Tables):
    return X.lagged_drawdown(t.portfolio).drop("ret")


@query("momentum", "feat", "SELECT series_id, date, momentum_5, momentum_20 FROM feat", "momentum_5 momentum_20")
def _(t: Tables):
    return X.momentum(t.portfolio).drop("ret")


@query("downside_vol", "feat", "SELECT series_id, date, downside_vol_20 FROM feat", "downside_vol_20")
def _(t: Tables):
    return X.downside_vol(t.portfolio).drop("ret")


@query("rolling_quantile", "feat", "SELECT series_id, date, rolling_q05_60 FROM feat", "rolling_q05_60")
def _(t: Tables):
    return X.rolling_quantile(t.portfolio).drop("ret")


@query("rolling_range", "feat", "SELECT series_id, date, rolling_range_20 FROM feat", "rolling_range_20")
def _(t: Tables):
    return X.rolling_range(t.portfolio).drop("ret")


SEVEN = " ".join(X.FEATURES_7)
TWELVE = " ".join(X.FEATURES_12)


@query("feature_table_7f", "feat", f"SELECT series_id, date AS target_date, {', '.join(X.FEATURES_7)} FROM feat", SEVEN)
def _(t: Tables):
    return X.feature_table_7f(t.portfolio)


@query("feature_table_12f", "feat12", "SELECT * FROM feat12", TWELVE + " actual_return")
def _(t: Tables):
    return X.feature_table_12f(t.portfolio)


@query("feature_table_12f_blocked", "feat12", "SELECT * FROM feat12", TWELVE + " actual_return")
def _(t: Tables):
    return X.feature_table_12f(t.portfolio, block=BLOCK)


@query("portfolio_range", "aligned", """
  SELECT date, avg((high - low) / close) AS portfolio_range FROM aligned GROUP BY 1
""", "portfolio_range")
def _(t: Tables):
    return X.portfolio_range(t.aligned)


@query("volume_change", "aligned", """
  SELECT date, avg(c) AS volume_change FROM (SELECT date, volume / lag(volume) OVER (PARTITION BY ticker ORDER BY date) - 1
    AS c FROM aligned) GROUP BY 1
""", "volume_change")
def _(t: Tables):
    return X.volume_change(t.aligned)


RELATIVE = """CASE WHEN count(volume) OVER w = 20 THEN volume / avg(volume) OVER w - 1 END"""


@query("relative_volume", "aligned", f"""
  SELECT date, avg(c) AS relative_volume_20 FROM (SELECT date, {RELATIVE} AS c FROM aligned
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY 1
""", "relative_volume_20")
def _(t: Tables):
    return X.relative_volume(t.aligned)


@query("market_return_lags", "idx", """
  SELECT ticker, date, r AS market_return_lag_1, lag(r, 4) OVER (PARTITION BY ticker ORDER BY date) AS market_return_lag_5
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM idx)
""", "market_return_lag_1 market_return_lag_5")
def _(t: Tables):
    return X.market_return_lags(t.index)


@query("market_vol", "idx", """
  SELECT ticker, date, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS market_vol_20
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM idx)
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""", "market_vol_20")
def _(t: Tables):
    return X.market_vol(t.index)


@query("market_feature_table", "aligned idx", f"""
  WITH stocks AS (SELECT date, avg((high - low) / close) AS a, avg(vc) AS b, avg(rv) AS c FROM (
      SELECT *, volume / lag(volume) OVER (PARTITION BY ticker ORDER BY date) - 1 AS vc, {RELATIVE} AS rv FROM aligned
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) GROUP BY 1),
    moved AS (SELECT stocks.*, idx.close / lag(idx.close) OVER (ORDER BY stocks.date) - 1 AS r
      FROM stocks LEFT JOIN idx ON stocks.date = idx.date)
  SELECT date AS target_date, lag(a) OVER o AS portfolio_range, lag(b) OVER o AS volume_change,
    lag(c) OVER o AS relative_volume_20, lag(r) OVER o AS market_return_lag_1, lag(r, 5) OVER o AS market_return_lag_5,
    CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS market_vol_20
  FROM moved WINDOW o AS (ORDER BY date), f AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""", " ".join(X.MARKET_FEATURES))
def _(t: Tables):
    return X.market_feature_table(t.bars, t.index, len(TICKERS))


@query("descriptive_rolling_vol", "port", """
  SELECT series_id, date, CASE WHEN count(ret) OVER a = 20 THEN stddev_samp(ret) OVER a END AS vol_20,
    CASE WHEN count(ret) OVER b = 60 THEN stddev_samp(ret) OVER b END AS vol_60 FROM port
  WINDOW a AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
""", "vol_20 vol_60")
def _(t: Tables):
    return X.descriptive_rolling_vol(t.portfolio, block=BLOCK).drop("ret")


@query("rolling_breach_rate", "pred", """
  SELECT series_id, method, target_date, CASE WHEN count(*) OVER w = 60 THEN avg(CAST(violation AS INTEGER)) OVER w END
    AS breach_rate FROM pred
  WINDOW w AS (PARTITION BY series_id, method ORDER BY target_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
""", "breach_rate")
def _(t: Tables):
    return X.rolling_breach_rate(t.predictions)


@query("cumulative_violations", "pred", """
  SELECT series_id, method, target_date, CAST(sum(CAST(violation AS INTEGER)) OVER (PARTITION BY series_id, method
    ORDER BY target_date) AS BIGINT) AS cumulative_violations, NOT violation AS covered FROM pred
""")
def _(t: Tables):
    return X.cumulative_violations(t.predictions)


@query("adjacent_var_changes", "pred", """
  SELECT series_id, method, target_date, var, lag(var) OVER w AS previous_var, var - lag(var) OVER w AS preceding_change,
    lead(var) OVER w AS next_var, lead(var) OVER w - var AS next_change
  FROM pred WINDOW w AS (PARTITION BY series_id, method ORDER BY target_date)
""", "var previous_var preceding_change next_var next_change")
def _(t: Tables):
    return X.adjacent_var_changes(t.predictions)
