"""Catalog: scans, sinks, registry and the session stream."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import clean_structural, normalize_columns
from ..session import scratch_path
from ..sources.bars import OHLCV, read_market_snapshot, read_ohlcv_csv, scan_panel
from ..sources.predictions import PREDICTION_FILE, read_predictions
from ..sources.registry import get_forecast, judge_forecasts, register_forecasts
from ..sources.sinks import RETURN_BITS, fingerprint_sql, snapshot_manifest, write_prediction_set, write_snapshot
from ..streaming.sessions import BATCH_END, SessionStore, ingest_sessions_stream
from .catalog import query
from .fixtures import CUTOFF, SPLIT, TICKERS, Tables

BAR_DOUBLES = " ".join(OHLCV)
BARS_SQL = "SELECT ticker, date, open, high, low, close, volume FROM"


@query("read_ohlcv_csv", "struct", "SELECT * FROM struct", BAR_DOUBLES)
def _(t: Tables):
    """Raw rows through text files: the order of rows in a file decides which copy of a date is last."""
    path = scratch_path(t.spark, "raw-bars")
    columns = ["ticker", "date", *OHLCV]
    ordered = t.raw_text.repartition("ticker").sortWithinPartitions("ticker", "ordinal")
    ordered.select(*columns).write.option("header", True).csv(path)
    return clean_structural(read_ohlcv_csv(t.spark, path, columns))


@query("scan_panel", "bars idx", f"{BARS_SQL} bars UNION ALL {BARS_SQL} idx", BAR_DOUBLES)
def _(t: Tables):
    return scan_panel([t.bars, t.index])


@query("tick_bars", "", """
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
    min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2
""", BAR_DOUBLES)
def _(t: Tables):
    return t.ticks


@query("index_bars", "idx", f"{BARS_SQL} idx", BAR_DOUBLES)
def _(t: Tables):
    return t.index


@query("read_predictions", "pred", """
  SELECT series_id, method, as_of, target_date, actual_return, quantile_return, var, violation FROM pred
""", "actual_return quantile_return var")
def _(t: Tables):
    path = scratch_path(t.spark, "predictions-text")
    text = t.predictions.withColumn("violation", F.initcap(F.col("violation").cast("string")))
    text.select(*PREDICTION_FILE).write.option("header", True).csv(path)
    return read_predictions(t.spark, path)


@query("read_market_snapshot", "bars", f"{BARS_SQL} bars", BAR_DOUBLES)
def _(t: Tables):
    untidy = t.bars.withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker")))
    return read_market_snapshot(normalize_columns(untidy), TICKERS)


@query("write_snapshot", "bars", f"{BARS_SQL} bars", BAR_DOUBLES)
def _(t: Tables):
    return write_snapshot(t.bars, scratch_path(t.spark, "snapshot"))


@query("write_prediction_set", "pred", """
  SELECT 'predictions' AS name, method, count(*) AS rows FROM pred GROUP BY 1, 2
  UNION ALL SELECT 'exceptions', method, count(*) FILTER (violation) FROM pred GROUP BY 1, 2
""")
def _(t: Tables):
    tables = {"predictions": t.predictions, "exceptions": t.predictions.filter("violation")}
    stored = write_prediction_set(tables, scratch_path(t.spark, "run"), {"predictions": ["method"]})
    result = None
    for name, table in stored.items():
        part = table.groupBy(F.lit(name).alias("name"), "method").agg(F.count(F.lit(1)).alias("rows"))
        result = part if result is None else result.unionByName(part)
    return result


MANIFEST = """SELECT ticker AS entry, count(*) AS rows, max(date) AS last_date,
    count(*) FILTER (abs(c) > 0.15) AS extreme_moves_flagged{bars}
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS c FROM bars) GROUP BY 1
  UNION ALL SELECT 'portfolio/' || series_id, count(*), max(date), 0{port} FROM port GROUP BY 1"""
BAR_KINDS = {"ticker": "text", "date": "text"} | {c: "double" for c in OHLCV}
PORT_KINDS = {"series_id": "text", "date": "text", "ret": "double"}


@query("snapshot_manifest", "bars port", MANIFEST.format(bars="", port=""))
def _(t: Tables):
    return snapshot_manifest(t.bars, t.portfolio).drop("content")


@query("snapshot_fingerprint", "bars port", MANIFEST.format(
    bars=f", {fingerprint_sql(BAR_KINDS)} AS content", port=f", {fingerprint_sql(PORT_KINDS, RETURN_BITS)}"))
def _(t: Tables):
    bars = t.bars.select(*BAR_KINDS)
    return snapshot_manifest(bars, t.portfolio.select(*PORT_KINDS))


def forecast_rows(t: Tables) -> DataFrame:
    """Registry rows of every prediction with one broken rule on some days and copies on others."""
    k = F.dayofmonth("target_date") % 10
    name = F.concat_ws("-", "series_id", "method")
    made = F.when(k == 2, F.col("target_date")).otherwise(F.col("as_of")).cast("timestamp") + F.expr("interval 10 hours")
    digest = F.sha2(F.concat_ws("|", "series_id", "method", "target_date"), 256)
    rows = t.predictions.select(
        F.concat_ws("-", name, "target_date").alias("forecast_id"),
        name.alias("model_name"),
        F.lit("v1").alias("model_version"),
        made.alias("generated_at"),
        F.col("as_of").alias("data_as_of_date"),
        "target_date",
        F.lit(0.05).alias("quantile_alpha"),
        F.when(k == 1, F.lit(-2.0)).otherwise(F.greatest("quantile_return", F.lit(-1.0))).alias("quantile_return"),
        F.date_sub("as_of", 400).alias("training_start"),
        F.col("as_of").alias("training_end"),
        F.lit("f12").alias("feature_version"),
        F.when(k == 4, "xyz").otherwise(digest).alias("config_hash"),
        digest.alias("data_hash"),
        F.sha1("method").alias("git_commit"),
        k.alias("_k"),
    )
    copies = rows.filter(F.col("_k") == 3).withColumn("forecast_id", F.concat("forecast_id", F.lit("-again")))
    return rows.unionByName(copies).drop("_k")


SPLIT_DAY = date.fromisoformat(SPLIT)


@query("register_forecasts", "pred", """
  SELECT series_id || '-' || method AS model_name, target_date, greatest(quantile_return, -1) AS quantile_return,
    greatest(0, -greatest(quantile_return, -1)) AS var_return FROM pred WHERE day(target_date) % 10 NOT IN (1, 2, 4)
""", "quantile_return var_return")
def _(t: Tables):
    """Two registrations; the second repeats the keys of the first, which stay untouched."""
    rows = forecast_rows(t)
    path, rejects = scratch_path(t.spark, "registry"), scratch_path(t.spark, "registry-rejects")
    register_forecasts(t.spark, path, rows.filter(F.col("target_date") <= F.lit(SPLIT_DAY)), rejects)
    stored = register_forecasts(t.spark, path, rows, rejects)
    return stored.select("model_name", "target_date", "quantile_return", "var_return")


@query("rejected_forecasts", "pred", f"""
  SELECT rejected_for, count(*) AS rows FROM (
    SELECT CASE k WHEN 1 THEN 'quantile' WHEN 2 THEN 'made_before_target' WHEN 4 THEN 'hashes' ELSE CASE WHEN
      target_date <= DATE '{SPLIT}' OR copy = 1 THEN 'duplicate_key' END END AS rejected_for
    FROM (SELECT *, day(target_date) % 10 AS k, 0 AS copy FROM pred
      UNION ALL SELECT *, 3, 1 FROM pred WHERE day(target_date) % 10 = 3)) GROUP BY 1
""")
def _(t: Tables):
    rows = forecast_rows(t)
    stored = judge_forecasts(None, rows.filter(F.col("target_date") <= F.lit(SPLIT_DAY))).filter("rejected_for IS NULL")
    return judge_forecasts(stored, rows).groupBy("rejected_for").agg(F.count(F.lit(1)).alias("rows"))


@query("get_forecast", "pred", """
  SELECT series_id || '-' || method || '-' || strftime(target_date, '%Y-%m-%d') AS forecast_id, target_date,
    greatest(quantile_return, -1) AS quantile_return, 'PENDING' AS status
  FROM pred WHERE series_id = 'ALL' AND method = 'ewma' AND day(target_date) % 10 NOT IN (1, 2, 4)
  ORDER BY target_date DESC LIMIT 1
""", "quantile_return")
def _(t: Tables):
    stored = judge_forecasts(None, forecast_rows(t)).filter("rejected_for IS NULL")
    last = stored.filter(F.col("model_name") == "ALL-ewma").agg(F.max_by("forecast_id", "target_date")).first()[0]
    return get_forecast(stored, last).select("forecast_id", "target_date", "quantile_return", "status")


@query("ingest_sessions_stream", "port", """
  SELECT date, ret AS portfolio_simple_return, ln(1 + ret) AS portfolio_log_return FROM port WHERE series_id = 'ALL'
""", "portfolio_simple_return portfolio_log_return")
def _(t: Tables):
    """Seed with the sessions up to a cutoff, then let the stream work off two later arrivals."""
    root = scratch_path(t.spark, "sessions")
    store = SessionStore(t.spark, f"{root}/store", len(TICKERS), as_of=BATCH_END)
    bars = t.aligned
    cutoff, later = F.lit(date.fromisoformat(CUTOFF)), F.lit(date(2001, 1, 31))
    store.seed(bars.filter(F.col("date") <= cutoff))
    text = bars.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("day"), "date", *OHLCV)
    arrivals = [
        (F.col("date") > F.date_sub(cutoff, 21)) & (F.col("date") <= later),
        F.col("date") > F.date_sub(later, 21),
    ]
    for arrival in arrivals:
        text.filter(arrival).select("ticker", F.col("day").alias("date"), *OHLCV).write.mode("append").option(
            "header", True
        ).csv(f"{root}/incoming")
        ingest_sessions_stream(store, f"{root}/incoming", f"{root}/checkpoint", files_per_batch=10_000)
    return store.portfolio()
