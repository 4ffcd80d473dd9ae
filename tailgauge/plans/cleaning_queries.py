"""Catalog: cleaning, quality and review of bars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import coerce_numeric, eligible_session, parse_trading_date
from ..operators import cleaning as C
from ..operators.quality import quality_report
from .catalog import query
from .fixtures import CUTOFF, TICKERS, Tables

OHLCV = "open high low close volume"
DAY = f"DATE '{CUTOFF}'"
LIMIT = date.fromisoformat(CUTOFF)


@query("normalize_columns", "bars", "SELECT ticker, date, open, high, low, close, volume FROM bars", OHLCV)
def _(t: Tables):
    odd = t.bars.toDF(" Ticker", "TIME", "Open ", " HIGH", "Low", "Close", "Volume")
    return C.require_columns(C.normalize_columns(odd))


@query("parse_trading_date", "", """
  SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(second + INTERVAL 7 HOUR AS DATE) END AS trading_date
  FROM (SELECT event_id, date_trunc('second', ts) AS second FROM events)
""")
def _(t: Tables):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    plain = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    local = F.date_format(ts + F.expr("interval 7 hours"), "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(F.col("event_id") % 4 == 0, plain)
        .when(F.col("event_id") % 4 == 1, F.concat(local, F.lit("+07:00")))
        .when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.concat(F.lit("day "), plain))
    )
    return t.source("events").select("event_id", parse_trading_date(text).alias("trading_date"))


@query("coerce_numeric", "", """
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE value END AS value FROM events
""", "value")
def _(t: Tables):
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, "n/a").when(kind == 1, "NaN").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return t.source("events").select("event_id", coerce_numeric(text).alias("value"))


STRUCTURAL = """
  SELECT f.ticker, raw_rows, date_parse_failures, missing_rows, duplicate_date_rows, nonpositive_price_rows,
    negative_volume_rows, dates_out_of_order
  FROM (SELECT ticker, count(*) AS raw_rows, count(*) FILTER (date IS NULL) AS date_parse_failures,
      count(*) FILTER (missing) AS missing_rows, count(*) FILTER (date IS NOT NULL AND copies > 1) AS duplicate_date_rows,
      count(*) FILTER (bad_price) AS nonpositive_price_rows, count(*) FILTER (bad_volume) AS negative_volume_rows
    FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM flags) GROUP BY 1) f
  JOIN (SELECT ticker, bool_or(date < before) AS dates_out_of_order FROM (
      SELECT *, lag(date) OVER (PARTITION BY ticker ORDER BY ordinal) AS before FROM flags WHERE date IS NOT NULL)
    GROUP BY 1) o ON f.ticker = o.ticker
"""


@query("structural_diagnostics", "flags", STRUCTURAL)
def _(t: Tables):
    return C.structural_diagnostics(t.raw_text)


@query("clean_structural", "struct", "SELECT * FROM struct", OHLCV)
def _(t: Tables):
    return C.clean_structural(t.raw_text)


BAD = """coalesce(high < open, false) OR coalesce(high < low, false) OR coalesce(high < close, false)
  OR coalesce(low > open, false) OR coalesce(low > close, false)"""


@query("ohlc_violations", "struct", f"""
  SELECT ticker, count(*) FILTER ({BAD}) AS invalid_ohlc_rows, min(date) FILTER ({BAD}) AS first_invalid,
    max(date) FILTER ({BAD}) AS last_invalid FROM struct GROUP BY 1
""")
def _(t: Tables):
    return C.ohlc_violation_summary(C.clean_structural(t.raw_text))


@query("drop_invalid_ohlc", "struct", f"SELECT * FROM struct WHERE NOT ({BAD})", OHLCV)
def _(t: Tables):
    return C.drop_invalid_ohlc(C.clean_structural(t.raw_text))


@query("flag_extreme_moves", "bars", """
  SELECT ticker, date, close, close_change FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1
    AS close_change FROM bars) WHERE abs(close_change) > 0.15
""", "close close_change")
def _(t: Tables):
    return C.flag_extreme_moves(t.bars)


@query("quality_report", "flags struct", f"""
  WITH s AS ({STRUCTURAL}),
    k AS (SELECT ticker, count(*) AS clean_rows, min(date) AS a, max(date) AS b FROM struct WHERE NOT ({BAD}) GROUP BY 1),
    o AS (SELECT ticker, count(*) FILTER ({BAD}) AS invalid_ohlc_rows FROM struct GROUP BY 1),
    m AS (SELECT ticker, count(*) AS extreme FROM (SELECT ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY
      date) - 1 AS c FROM struct WHERE NOT ({BAD})) WHERE abs(c) > 0.15 GROUP BY 1),
    w AS (SELECT unnest(['A', 'N', 'R', 'ZZZ']) AS ticker)
  SELECT w.ticker, CASE WHEN raw_rows IS NULL THEN 'FAIL' WHEN date_parse_failures > 0 OR missing_rows > 0 OR
      duplicate_date_rows > 0 OR nonpositive_price_rows > 0 OR negative_volume_rows > 0 OR invalid_ohlc_rows > 0 OR
      dates_out_of_order OR coalesce(extreme, 0) > 0 THEN 'REVIEW' ELSE 'PASS' END AS quality_status,
    coalesce(raw_rows, 0) AS raw_rows, coalesce(clean_rows, 0) AS clean_rows,
    coalesce(raw_rows - coalesce(clean_rows, 0), 0) AS rows_removed,
    coalesce(date_parse_failures, 0) AS date_parse_failures, coalesce(missing_rows, 0) AS missing_rows,
    coalesce(duplicate_date_rows, 0) AS duplicate_date_rows, coalesce(nonpositive_price_rows, 0) AS nonpositive_price_rows,
    coalesce(negative_volume_rows, 0) AS negative_volume_rows, coalesce(invalid_ohlc_rows, 0) AS invalid_ohlc_rows,
    coalesce(dates_out_of_order, false) AS dates_out_of_order, coalesce(extreme, 0) AS extreme_close_move_rows,
    coalesce(strftime(a, '%Y-%m-%d'), '') AS start_date, coalesce(strftime(b, '%Y-%m-%d'), '') AS end_date,
    CASE WHEN raw_rows IS NULL THEN '' ELSE 'clean/ticker=' || w.ticker END AS processed_file,
    CASE WHEN raw_rows IS NULL THEN 'missing_input' ELSE 'success' END AS pipeline_status
  FROM w LEFT JOIN s ON w.ticker = s.ticker LEFT JOIN k ON w.ticker = k.ticker LEFT JOIN o ON w.ticker = o.ticker
    LEFT JOIN m ON w.ticker = m.ticker
""")
def _(t: Tables):
    return quality_report(t.raw_text, [*TICKERS, "zzz"])


LENIENT = f"""SELECT *, NOT missing AND NOT bad_price AND NOT bad_volume AND ordered AS valid FROM (
  SELECT *, coalesce(high >= greatest(open, low, close) AND low <= least(open, high, close), false) AS ordered FROM flags)"""


@query("lenient_normalize", "flags", f"""
  SELECT ticker, date, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date
    ORDER BY ordinal DESC) AS rn FROM ({LENIENT}) WHERE valid) WHERE rn = 1
""", OHLCV)
def _(t: Tables):
    return C.lenient_normalize(t.raw_text)[0]


@query("lenient_diagnostics", "flags", f"""
  SELECT ticker, count(*) AS raw_rows, count(DISTINCT date) FILTER (valid) AS clean_rows,
    count(*) FILTER (missing) AS missing_rows_before_cleaning,
    count(*) FILTER (copies > 1) AS duplicate_dates_before_cleaning, count(*) FILTER (NOT ordered) AS invalid_ohlc_rows,
    min(date) FILTER (valid) AS start_date, max(date) FILTER (valid) AS end_date
  FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM ({LENIENT})) GROUP BY 1
""")
def _(t: Tables):
    return C.lenient_normalize(t.raw_text)[1]


@query("strict_violations", "flags", f"""
  SELECT ticker, count(*) AS rows, count(*) FILTER (date IS NULL) AS invalid_date,
    count(DISTINCT date) FILTER (copies > 1) AS duplicate_dates,
    count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS not_finite,
    count(*) FILTER (bad_price) AS nonpositive_price, count(*) FILTER (bad_volume) AS negative_volume,
    count(*) FILTER (bad_ohlc) AS invalid_ohlc
  FROM (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM flags) WHERE date IS NULL OR date <= {DAY}
  GROUP BY 1
""")
def _(t: Tables):
    return C.strict_violations(t.raw_text, F.lit(LIMIT))


@query("strict_normalize", "bars", f"SELECT ticker, date, open, high, low, close, volume FROM bars WHERE date <= {DAY}", OHLCV)
def _(t: Tables):
    return C.strict_normalize(t.clean_text, F.lit(LIMIT))


SESSION = """CAST(day - INTERVAL 1 DAY * greatest(isodow(day) - 5, 0) AS DATE)"""
LOCAL_DAY = """CASE WHEN hour(local) >= 17 THEN CAST(local AS DATE) ELSE CAST(local - INTERVAL 1 DAY AS DATE) END"""


@query("eligible_session", "", f"""
  SELECT event_id, {SESSION} AS session FROM (SELECT event_id, {LOCAL_DAY} AS day FROM (
    SELECT event_id, ts + INTERVAL 7 HOUR AS local FROM events))
""")
def _(t: Tables):
    return t.source("events").select("event_id", eligible_session(F.col("ts").cast("timestamp")).alias("session"))


@query("eligible_sessions_open", "", f"""
  SELECT session, count(*) AS events FROM (SELECT {SESSION} AS session FROM (SELECT {LOCAL_DAY} AS day FROM (
    SELECT ts + INTERVAL 7 HOUR AS local FROM events)))
  WHERE session NOT IN (DATE '2024-01-01', DATE '2024-01-15') GROUP BY 1
""")
def _(t: Tables):
    closed = t.spark.sql("SELECT explode(array(DATE '2024-01-01', DATE '2024-01-15')) AS date")
    instants = t.source("events").select(F.col("ts").cast("timestamp").alias("ts"))
    return C.eligible_sessions(instants, "ts", closed).groupBy("session").agg(F.count(F.lit(1)).alias("events"))


@query("rescale_price_unit", "bars idx", """
  SELECT ticker, date, price_unit, open / f AS open, high / f AS high, low / f AS low, close / f AS close, volume FROM (
    SELECT *, CASE price_unit WHEN 'vnd' THEN 1e3 ELSE 1e0 END AS f FROM (
      SELECT *, CASE WHEN ticker = 'A' THEN 'vnd' WHEN ticker = 'N' THEN 'thousand_vnd' END AS price_unit FROM bars
      UNION ALL SELECT *, 'index_points' FROM idx))
""", OHLCV, digits=11)
def _(t: Tables):
    unit = F.when(F.col("ticker") == "A", "vnd").when(F.col("ticker") == "N", "thousand_vnd")
    both = t.bars.withColumn("price_unit", unit).unionByName(t.index.withColumn("price_unit", F.lit("index_points")))
    return C.rescale_price_unit(both, stocks=F.col("ticker") != "MKT")


@query("freshness_check", "bars", f"""
  WITH l AS (SELECT ticker, max(date) AS last_date FROM bars WHERE ticker <> 'N' OR date < {DAY} GROUP BY 1)
  SELECT ticker, last_date, last_date < (SELECT max(date) FROM bars) - INTERVAL 4 DAY AS stale,
    last_date <> (SELECT max(last_date) FROM l) AS behind_others,
    last_date <> (SELECT max(date) FROM bars) AS not_expected FROM l
""")
def _(t: Tables):
    late = t.bars.filter((F.col("ticker") != "N") | (F.col("date") < F.lit(LIMIT)))
    expected = t.bars.agg(F.max("date")).first()[0]
    return C.freshness_check(late, F.lit(expected))


GAPS = "open high low close high_gap low_gap max_gap_points"


@query("review_anomalies", "anomalies", "SELECT *, true AS reviewed FROM anomalies", GAPS)
def _(t: Tables):
    return C.review_anomalies(t.broken_index, t.reviewed)


@query("filter_reviewed_anomalies", "anomalies bidx", """
  SELECT ticker, date, open, high, low, close, volume FROM bidx WHERE date NOT IN (SELECT date FROM anomalies)
""", OHLCV)
def _(t: Tables):
    return C.filter_reviewed_anomalies(t.broken_index, t.reviewed)[0]


@query("reconcile_anomaly_audit", "anomalies", """
  SELECT *, CAST(2 AS BIGINT) AS copies, 0e0 AS spread FROM anomalies
""", GAPS)
def _(t: Tables):
    found = C.anomaly_gaps(t.broken_index)
    return C.reconcile_anomaly_audit(found, found)


@query("filter_period", "bars", """
  SELECT period, ticker, count(*) AS sessions, min(date) AS first_date, avg(close) AS mean_close FROM (
    SELECT bars.*, max(date) OVER (PARTITION BY ticker) AS last FROM bars) CROSS JOIN
    (SELECT unnest(['1M', '3M', '6M', 'YTD', '1Y', 'All']) AS period)
  WHERE date >= CASE period WHEN '1M' THEN last - INTERVAL 1 MONTH WHEN '3M' THEN last - INTERVAL 3 MONTH
    WHEN '6M' THEN last - INTERVAL 6 MONTH WHEN 'YTD' THEN date_trunc('year', last) WHEN '1Y' THEN last - INTERVAL 1 YEAR
    ELSE date END
  GROUP BY 1, 2
""", "mean_close", digits=6)
def _(t: Tables):
    result = None
    for period in ("1M", "3M", "6M", "YTD", "1Y", "All"):
        part = C.filter_period(t.bars, period).groupBy(F.lit(period).alias("period"), "ticker").agg(
            F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first_date"), F.avg("close").alias("mean_close")
        )
        result = part if result is None else result.unionByName(part)
    return result


@query("availability_matrix", "bars bidx anomalies", f"""
  WITH every AS (SELECT * FROM bars UNION ALL SELECT * FROM bidx WHERE date NOT IN (SELECT date FROM anomalies)),
    cal AS (SELECT DISTINCT date FROM bars), sym AS (SELECT unnest(['A', 'N', 'R', 'MKT']) AS ticker)
  SELECT cal.date, sym.ticker, CASE WHEN every.date IS NOT NULL THEN CASE WHEN {BAD} THEN 'invalid' ELSE 'valid' END
    WHEN anomalies.date IS NOT NULL THEN 'excluded' ELSE 'absent' END AS state
  FROM cal CROSS JOIN sym LEFT JOIN every ON every.date = cal.date AND every.ticker = sym.ticker
    LEFT JOIN (SELECT ticker, date FROM anomalies) anomalies ON anomalies.date = cal.date AND anomalies.ticker = sym.ticker
""")
def _(t: Tables):
    kept, audit = C.filter_reviewed_anomalies(t.broken_index, t.reviewed)
    return C.availability_matrix(t.bars.unionByName(kept), [*TICKERS, "MKT"], audit, t.bars)


QUALITY = ", ".join(
    f"count({c}) AS valid_{c}s, count(*) FILTER ({c} IS NULL) AS missing_{c}s, "
    f"count(*) FILTER (isinf({c}) AND {c} > 0) AS positive_inf_{c}s, "
    f"count(*) FILTER (isinf({c}) AND {c} < 0) AS negative_inf_{c}s, min({c}) AS {c}_min, max({c}) AS {c}_max"
    for c in ("simple_return", "log_return")
)


@query("return_quality", "bars", f"""
  SELECT ticker, count(*) AS observations, {QUALITY}, count(*) FILTER (simple_return <= -1) AS invalid_log_domain
  FROM (SELECT ticker, close / lag(close) OVER w - 1 AS simple_return, ln(close / lag(close) OVER w) AS log_return
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) GROUP BY 1
""", "simple_return_min simple_return_max log_return_min log_return_max")
def _(t: Tables):
    from ..operators.returns import both_returns

    return C.return_quality(both_returns(t.bars))
