"""Input tables of the catalog, derived by Spark from the trade and event tables.

Every derivation reads the whole source table.  ``CTES`` states the same tables
in SQL for the result check.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered_by
from ..models.folds import expanding_folds
from ..models.quantile_boosting import Candidate
from ..models.refits import walk_forward_model
from ..models.walk_forward import compare_methods
from ..operators.alignment import align_calendars
from ..operators.features import FEATURES_7, feature_table_12f
from ..operators.returns import both_returns, portfolio_series
from ..session import materialize
from ..sources.bars import OHLCV, bars_from_cells, hundredths, merge_cells, packed_order, tick_bars, trade_cells
from .boosting_sql import FINAL, boosted, refit_tasks

TICKERS = ["A", "N", "R"]
CUTOFF = "2000-06-30"
OVERLAP_START = "2000-06-01"
SPLIT = "1999-06-30"
# Portfolio, ticker and number of members.
WEIGHTS = [("ALL", t, 3) for t in TICKERS] + [(t, t, 1) for t in TICKERS]
# Session position in the index and gap in points of the reviewed anomalies.
ANOMALIES = [(10, 5.0), (20, 7.5), (30, 2.25)]
# The boosted model of the three-method tables: short and rarely refit, because SQL repeats it in every query that needs it.
THREE = Candidate(stages=8, learning_rate=0.2, max_depth=2, min_leaf=5)
FIRST, REFIT_EVERY = 250, 1000


class Tables:
    """Lazily derived inputs of one data directory."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @functools.cached_property
    def cells(self) -> DataFrame:
        """Trade cells as a table of their own: the trades are scanned once, however many branches follow."""
        return materialize(self.trade_cells(), "cells")

    def trade_cells(self) -> DataFrame:
        trades = self.source("lineitem")
        order = packed_order(
            F.col("l_orderkey") * 100 + F.col("l_linenumber"),
            hundredths(F.col("l_extendedprice")) * 1_000_000 + hundredths(F.col("l_quantity")),
        )
        return trade_cells(
            trades,
            ticker=F.col("l_returnflag"),
            date=F.to_date("l_shipdate"),
            price=F.col("l_extendedprice") / F.col("l_quantity"),
            quantity=F.col("l_quantity"),
            notional=F.col("l_extendedprice"),
            order=order,
        )

    @functools.cached_property
    def bars(self) -> DataFrame:
        return bars_from_cells(self.cells)

    @functools.cached_property
    def index(self) -> DataFrame:
        return bars_from_cells(merge_cells(self.cells, F.lit("MKT")))

    @functools.cached_property
    def aligned(self) -> DataFrame:
        return align_calendars(self.bars, len(TICKERS))

    @functools.cached_property
    def returns(self) -> DataFrame:
        """Simple and log returns of aligned sessions, first session dropped."""
        return both_returns(self.aligned).filter(F.col("simple_return").isNotNull())

    @functools.cached_property
    def weights(self) -> DataFrame:
        rows = [(portfolio, ticker, 1.0 / members) for portfolio, ticker, members in WEIGHTS]
        return self.spark.createDataFrame(rows, "portfolio_id string, ticker string, weight double")

    @functools.cached_property
    def portfolio(self) -> DataFrame:
        """Daily returns of every portfolio, a table of its own: most plans read it several times."""
        return materialize(portfolio_series(self.bars, self.weights, len(TICKERS)), "portfolio")

    @functools.cached_property
    def predictions(self) -> DataFrame:
        """Forecasts of three methods on common targets, a table of its own."""
        return materialize(compare_methods(self.portfolio, self.boosted), "predictions")

    @functools.cached_property
    def boosted(self) -> DataFrame:
        """Walk-forward forecasts of the boosted model, a table of its own."""
        return materialize(walk_forward_model(self.features, THREE, FEATURES_7, FIRST, REFIT_EVERY), "boosted")

    @functools.cached_property
    def features(self) -> DataFrame:
        return feature_table_12f(self.portfolio)

    @functools.cached_property
    def fold_predictions(self) -> DataFrame:
        """Predictions of the baseline methods on the validation folds of the feature table."""
        folds = expanding_folds(self.features).select("series_id", "target_date", F.col("fold").cast("string"))
        return (
            self.predictions.join(folds.filter(F.col("fold") != "0"), ["series_id", "target_date"])
            .withColumnRenamed("method", "model")
            .select("series_id", "model", "fold", "as_of", "target_date", "actual_return", "quantile_return", "var",
                    "violation")
        )

    @functools.cached_property
    def ticks(self) -> DataFrame:
        return tick_bars(
            self.source("events"),
            ticker=F.col("event_type"),
            date=F.to_date("ts"),
            price=F.col("value"),
            quantity=F.lit(1),
            order=packed_order(F.unix_micros(F.col("ts").cast("timestamp")), "event_id"),
            close="last",
        )

    @functools.cached_property
    def raw_text(self) -> DataFrame:
        """Bars as text rows of an unsorted file with faults at fixed positions."""
        i = F.col("_i")
        at = i % 50
        copies = F.explode(F.when(at == 37, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        numbered = self.bars.withColumn("_i", (F.row_number().over(ordered_by("ticker")) - 1).cast("long"))
        rows = numbered.withColumn("_copy", copies)
        evening = F.concat(F.date_format(F.date_sub("date", 1), "yyyy-MM-dd"), F.lit(" 20:00:00"))
        day = F.when(i % 3 == 0, evening).otherwise(F.date_format("date", "yyyy-MM-dd"))
        text = {c: F.col(c).cast("string") for c in OHLCV}
        return rows.select(
            F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("ticker"),
            (i * 10 + F.when(F.col("_copy") == 1, 5).when(at == 41, -25).otherwise(0)).alias("ordinal"),
            F.when(at == 7, "not a date").otherwise(day).alias("date"),
            F.when(at == 19, "").otherwise(text["open"]).alias("open"),
            F.when(at == 31, (F.col("low") * 0.5).cast("string")).otherwise(text["high"]).alias("high"),
            F.when(at == 23, "0").otherwise(text["low"]).alias("low"),
            F.when(F.col("_copy") == 1, text["low"])
            .when(at == 13, "abc")
            .otherwise(text["close"])
            .alias("close"),
            F.when(at == 29, "-5").otherwise(text["volume"]).alias("volume"),
        )

    @functools.cached_property
    def clean_text(self) -> DataFrame:
        """Bars as text without faults."""
        return self.bars.select(
            "ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), *[F.col(c).cast("string").alias(c) for c in OHLCV]
        )

    @functools.cached_property
    def _numbered_index(self) -> DataFrame:
        return self.index.withColumn("_i", F.row_number().over(ordered_by("ticker")) - 1)

    @functools.cached_property
    def broken_index(self) -> DataFrame:
        """Index bars whose high is too low at the reviewed positions."""
        high = F.col("high")
        for position, gap in ANOMALIES:
            high = F.when(F.col("_i") == position, F.greatest("open", "low", "close") - F.lit(gap)).otherwise(high)
        return self._numbered_index.withColumn("high", high).drop("_i")

    @functools.cached_property
    def reviewed(self) -> DataFrame:
        gap = F.lit(None).cast("double")
        for position, points in ANOMALIES:
            gap = F.when(F.col("_i") == position, F.lit(points)).otherwise(gap)
        return self._numbered_index.select("ticker", "date", gap.alias("gap")).filter(F.col("gap").isNotNull())

    @functools.cached_property
    def old(self) -> DataFrame:
        return self.bars.filter(F.col("date") <= F.lit(CUTOFF).cast("date"))

    @functools.cached_property
    def new(self) -> DataFrame:
        return self.bars.filter(F.col("date") > F.lit(OVERLAP_START).cast("date"))

    @functools.cached_property
    def revised(self) -> DataFrame:
        """The incoming bars with every close of one ticker in the overlap one percent higher."""
        changed = (F.col("ticker") == "A") & (F.col("date") <= F.lit(CUTOFF).cast("date"))
        return self.new.withColumn("close", F.when(changed, F.col("close") * 1.01).otherwise(F.col("close")))


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": ((), """
      SELECT ticker, date, open, greatest(top, close) AS high, least(bottom, close) AS low, close, volume FROM (
        SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS date,
          first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS open,
          max(l_extendedprice / l_quantity) AS top, min(l_extendedprice / l_quantity) AS bottom,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
            / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
          CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
        FROM lineitem GROUP BY 1, 2)"""),
    "idx": ((), """
      SELECT ticker, date, open, greatest(top, close) AS high, least(bottom, close) AS low, close, volume FROM (
        SELECT 'MKT' AS ticker, CAST(l_shipdate AS DATE) AS date,
          first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS open,
          max(l_extendedprice / l_quantity) AS top, min(l_extendedprice / l_quantity) AS bottom,
          CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
            / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
          CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume
        FROM lineitem GROUP BY 1, 2)"""),
    "aligned": (("bars",), """
      SELECT * FROM bars WHERE date IN (SELECT date FROM bars GROUP BY date HAVING count(*) = 3)"""),
    "rets": (("aligned",), """
      SELECT * FROM (SELECT *, close / lag(close) OVER w - 1 AS simple_return, ln(close / lag(close) OVER w) AS log_return
        FROM aligned WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE simple_return IS NOT NULL"""),
    "weights": ((), """
      SELECT * FROM (VALUES ('ALL','A',1e0/3),('ALL','N',1e0/3),('ALL','R',1e0/3),('A','A',1e0),('N','N',1e0),('R','R',1e0))
        AS t(portfolio_id, ticker, weight)"""),
    "port": (("rets", "weights"), """
      SELECT portfolio_id AS series_id, date, sum(weight * simple_return) AS ret
      FROM rets JOIN weights USING (ticker) GROUP BY 1, 2"""),
    "ewma": (("port",), """
      SELECT series_id, date, ret, i, v, lag(v) OVER (PARTITION BY series_id ORDER BY i) AS v_before FROM (
        SELECT *, pow(94e-2, i) * sum(x * pow(94e-2, -i)) OVER (PARTITION BY series_id ORDER BY i) AS v FROM (
          SELECT *, CASE WHEN i = 0 THEN ret * ret ELSE (1 - 94e-2) * ret * ret END AS x FROM (
            SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM port)))"""),
    "predw": (("ewma",), """
      SELECT series_id, date, ret, lag(date) OVER w AS as_of,
        CASE WHEN count(ret) OVER w250 = 250 THEN quantile_cont(ret, 0.05) OVER w250 END AS q250,
        CASE WHEN count(ret) OVER w125 = 125 THEN quantile_cont(ret, 0.05) OVER w125 END AS q125,
        -1.6448536269514726e0 * sqrt(v_before) AS qe
      FROM ewma WINDOW w AS (PARTITION BY series_id ORDER BY date),
        w250 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING),
        w125 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING)"""),
    "boost": (("feat12",), boosted(
        refit_tasks(FIRST, REFIT_EVERY), {"model": THREE}, FEATURES_7, f"SELECT series_id, target_date, p AS qb FROM {FINAL}")),
    "pred": (("predw", "boost"), """
      SELECT series_id, method, as_of, date AS target_date, ret AS actual_return, q AS quantile_return,
        greatest(0e0, -q) AS var, ret < q AS violation
      FROM (WITH common AS (SELECT p.*, qb FROM predw p JOIN boost b ON b.series_id = p.series_id AND target_date = date
          WHERE q250 IS NOT NULL AND qe IS NOT NULL)
        SELECT *, 'historical_simulation' AS method, q250 AS q FROM common
        UNION ALL SELECT *, 'ewma', qe FROM common
        UNION ALL SELECT *, 'gradient_boosting', qb FROM common)"""),
    "scored": (("pred",), """
      SELECT *, greatest(0.05 * (actual_return - quantile_return), -0.95 * (actual_return - quantile_return)) AS loss
      FROM pred"""),
    "rawx": (("bars",), """
      SELECT ticker, CASE WHEN i % 50 = 41 THEN i * 10 - 25 ELSE i * 10 END AS ordinal,
        CASE WHEN i % 50 <> 7 THEN date END AS date, CASE WHEN i % 50 <> 19 THEN open END AS open,
        CASE WHEN i % 50 = 31 THEN low * 0.5 ELSE high END AS high, CASE WHEN i % 50 = 23 THEN 0 ELSE low END AS low,
        CASE WHEN i % 50 <> 13 THEN close END AS close, CASE WHEN i % 50 = 29 THEN -5 ELSE volume END AS volume
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars)
      UNION ALL
      SELECT ticker, i * 10 + 5, date, open, high, low, low, volume
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM bars) WHERE i % 50 = 37"""),
    "flags": (("rawx",), """
      SELECT *, date IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL AS missing,
        coalesce(open <= 0, false) OR coalesce(high <= 0, false) OR coalesce(low <= 0, false)
          OR coalesce(close <= 0, false) AS bad_price,
        coalesce(volume < 0, false) AS bad_volume,
        coalesce(high < open, false) OR coalesce(high < low, false) OR coalesce(high < close, false)
          OR coalesce(low > open, false) OR coalesce(low > close, false) AS bad_ohlc
      FROM rawx"""),
    "struct": (("flags",), """
      SELECT ticker, date, open, high, low, close, volume FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ordinal DESC) AS rn
        FROM flags WHERE NOT missing AND NOT bad_price AND NOT bad_volume) WHERE rn = 1"""),
    "bidx": (("idx",), """
      SELECT ticker, date, open, CASE i WHEN 10 THEN greatest(open, low, close) - 5 WHEN 20 THEN
        greatest(open, low, close) - 7.5 WHEN 30 THEN greatest(open, low, close) - 2.25 ELSE high END AS high,
        low, close, volume
      FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM idx)"""),
    "anomalies": (("bidx",), """
      SELECT * FROM (SELECT ticker, date, open, high, low, close, high_gap, low_gap, greatest(high_gap, low_gap) AS
        max_gap_points FROM (SELECT *, greatest(greatest(open, low, close) - high, 0) AS high_gap,
          greatest(low - least(open, high, close), 0) AS low_gap FROM bidx)) WHERE max_gap_points > 1e-8"""),
    "oldb": (("bars",), f"SELECT * FROM bars WHERE date <= DATE '{CUTOFF}'"),
    "newb": (("bars",), f"SELECT * FROM bars WHERE date > DATE '{OVERLAP_START}'"),
    "matrix": (("pred",), """
      SELECT series_id, target_date,
        bool_or(violation) FILTER (method = 'historical_simulation') AS historical_violation,
        bool_or(violation) FILTER (method = 'ewma') AS ewma_violation,
        bool_or(violation) FILTER (method = 'gradient_boosting') AS gb_violation,
        max(actual_return) AS actual_return, count(*) FILTER (violation) AS violation_method_count,
        strftime(target_date, '%Y-%m') AS calendar_month
      FROM pred GROUP BY 1, 2"""),
    "matrixc": (("matrix",), """
      SELECT *, CASE WHEN violation_method_count = 3 THEN 'shared_all_3' WHEN violation_method_count = 2
        THEN 'shared_exactly_2' WHEN historical_violation THEN 'historical_only' WHEN ewma_violation THEN 'ewma_only'
        WHEN gb_violation THEN 'gb_only' ELSE 'no_violation' END AS exception_category,
        row_number() OVER (PARTITION BY series_id ORDER BY target_date) - 1 AS target_position FROM matrix"""),
    "near": (("matrixc",), """
      SELECT * EXCLUDE (opens), CAST(sum(opens) OVER (PARTITION BY series_id ORDER BY target_date) AS BIGINT) AS cluster_id
      FROM (SELECT *, CASE WHEN target_position - lag(target_position) OVER (PARTITION BY series_id ORDER BY target_date)
        <= 2 THEN 0 ELSE 1 END AS opens FROM matrixc WHERE violation_method_count > 0)"""),
    "runs": (("pred",), """
      SELECT series_id, method, min(target_date) AS cluster_start, max(target_date) AS cluster_end, count(*) AS length,
        max(quantile_return - actual_return) AS max_exceedance
      FROM (SELECT *, p - row_number() OVER (PARTITION BY series_id, method ORDER BY target_date) AS run FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id, method ORDER BY target_date) AS p FROM pred)
        WHERE violation) GROUP BY series_id, method, run"""),
    "two": (("pred",), """
      SELECT *, CASE WHEN historical_violation AND ewma_violation THEN 'both' WHEN historical_violation THEN
        'historical_only' WHEN ewma_violation THEN 'ewma_only' ELSE 'none' END AS exception_type FROM (
        SELECT series_id, target_date, max(actual_return) AS actual_return,
          bool_or(violation) FILTER (method = 'historical_simulation') AS historical_violation,
          max(var) FILTER (method = 'historical_simulation') AS historical_var,
          max(greatest(0, quantile_return - actual_return)) FILTER (method = 'historical_simulation') AS historical_exceedance,
          bool_or(violation) FILTER (method = 'ewma') AS ewma_violation,
          max(var) FILTER (method = 'ewma') AS ewma_var,
          max(greatest(0, quantile_return - actual_return)) FILTER (method = 'ewma') AS ewma_exceedance
        FROM pred WHERE method <> 'gradient_boosting' GROUP BY 1, 2)"""),
    "regimes": (("pred", "port"), """
      WITH prior AS (SELECT series_id, date, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS
          prior_vol FROM port WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
        starts AS (SELECT series_id, min(target_date) AS s FROM pred GROUP BY 1),
        bounds AS (SELECT series_id, quantile_cont(prior_vol, 1e0/3) AS low_vol_threshold,
          quantile_cont(prior_vol, 2e0/3) AS high_vol_threshold FROM prior JOIN starts USING (series_id)
          WHERE date < s AND prior_vol IS NOT NULL GROUP BY 1)
      SELECT pred.*, prior_vol, low_vol_threshold, high_vol_threshold, CASE WHEN prior_vol < low_vol_threshold THEN 'LOW'
        WHEN prior_vol > high_vol_threshold THEN 'HIGH' ELSE 'NORMAL' END AS regime
      FROM pred JOIN prior ON pred.series_id = prior.series_id AND target_date = date
        JOIN bounds ON pred.series_id = bounds.series_id"""),
    "diag": (("scored",), """
      SELECT *, gb_pinball_loss - historical_pinball_loss AS gb_minus_historical_pinball,
        gb_pinball_loss - ewma_pinball_loss AS gb_minus_ewma_pinball,
        ewma_pinball_loss - historical_pinball_loss AS ewma_minus_historical_pinball
      FROM (SELECT series_id, target_date, max(actual_return) AS actual_return,
        max(quantile_return) FILTER (method = 'historical_simulation') AS historical_quantile_return,
        max(quantile_return) FILTER (method = 'ewma') AS ewma_quantile_return,
        max(quantile_return) FILTER (method = 'gradient_boosting') AS gb_quantile_return,
        max(var) FILTER (method = 'historical_simulation') AS historical_var,
        max(var) FILTER (method = 'ewma') AS ewma_var, max(var) FILTER (method = 'gradient_boosting') AS gb_var,
        max(loss) FILTER (method = 'historical_simulation') AS historical_pinball_loss,
        max(loss) FILTER (method = 'ewma') AS ewma_pinball_loss,
        max(loss) FILTER (method = 'gradient_boosting') AS gb_pinball_loss FROM scored GROUP BY 1, 2)"""),
    "deltas": (("diag",), """
      SELECT *, CASE WHEN delta < -1e-15 THEN -delta ELSE 0 END AS gain FROM (
        SELECT series_id, target_date, 'gb_vs_historical' AS comparison, gb_minus_historical_pinball AS delta FROM diag
        UNION ALL SELECT series_id, target_date, 'gb_vs_ewma', gb_minus_ewma_pinball FROM diag
        UNION ALL SELECT series_id, target_date, 'ewma_vs_historical', ewma_minus_historical_pinball FROM diag)"""),
    "feat": (("port",), """
      SELECT series_id, date, ret, lag(date) OVER w AS as_of, lag(ret, 1) OVER w AS return_lag_1,
        lag(ret, 2) OVER w AS return_lag_2, lag(ret, 5) OVER w AS return_lag_5,
        CASE WHEN count(ret) OVER w5 = 5 THEN stddev_samp(ret) OVER w5 END AS rolling_vol_5,
        CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS rolling_vol_20,
        CASE WHEN count(ret) OVER w60 = 60 THEN stddev_samp(ret) OVER w60 END AS rolling_vol_60,
        lag(exp(s - m) - 1) OVER w AS drawdown,
        CASE WHEN count(ret) OVER w5 = 5 THEN exp(sum(ln(1 + ret)) OVER w5) - 1 END AS momentum_5,
        CASE WHEN count(ret) OVER w20 = 20 THEN exp(sum(ln(1 + ret)) OVER w20) - 1 END AS momentum_20,
        CASE WHEN count(ret) OVER w20 = 20 THEN sqrt(avg(pow(least(ret, 0), 2)) OVER w20) END AS downside_vol_20,
        CASE WHEN count(ret) OVER w60 = 60 THEN quantile_cont(ret, 0.05) OVER w60 END AS rolling_q05_60,
        CASE WHEN count(ret) OVER w20 = 20 THEN max(ret) OVER w20 - min(ret) OVER w20 END AS rolling_range_20
      FROM (SELECT *, max(s) OVER (PARTITION BY series_id ORDER BY date) AS m FROM (
        SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY series_id ORDER BY date) AS s FROM port))
      WINDOW w AS (PARTITION BY series_id ORDER BY date),
        w5 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        w20 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
        w60 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""),
    "feat12": (("feat",), """
      SELECT series_id, date AS target_date, as_of, return_lag_1, return_lag_2, return_lag_5, rolling_vol_5,
        rolling_vol_20, rolling_vol_60, drawdown, momentum_5, momentum_20, downside_vol_20, rolling_q05_60,
        rolling_range_20, ret AS actual_return FROM feat WHERE rolling_vol_60 IS NOT NULL"""),
    "folded": (("feat12",), """
      SELECT *, CASE WHEN position < first THEN 0 ELSE CAST((position - first) // width AS INTEGER) + 1 END AS fold
      FROM (SELECT *, n // 6 AS width, n - 5 * (n // 6) AS first FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY target_date) - 1 AS position,
          count(*) OVER (PARTITION BY series_id) AS n FROM feat12))"""),
    "foldpred": (("pred", "folded"), """
      SELECT pred.*, method AS model, CAST(folded.fold AS VARCHAR) AS fold
      FROM pred JOIN folded USING (series_id, target_date) WHERE fold > 0"""),
    "metrics": (("scored",), """
      SELECT series_id, method, count(*) AS forecast_count, count(*) FILTER (violation) AS violation_count,
        count(*) FILTER (violation) / count(*) AS violation_rate, avg(loss) AS pinball_loss, avg(var) AS average_var,
        min(var) AS minimum_var, max(var) AS maximum_var, min(target_date) AS test_start, max(target_date) AS test_end
      FROM scored GROUP BY 1, 2"""),
}
MATERIALIZED = {"bars", "idx", "port", "pred", "feat", "predw", "boost"}


def with_tables(names: tuple[str, ...], body: str) -> str:
    """Prefix a SELECT with the tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({CTES[name][1].strip()})" for name in order
    ]
    return f"WITH {', '.join(parts)} {body}" if parts else body
