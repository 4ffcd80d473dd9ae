"""Incremental ingest of new sessions as a file stream."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import coerce_numeric, eligible_session, parse_trading_date
from ..operators.alignment import calendar_mismatch, new_sessions, revised_rows
from ..operators.cleaning import PRICES, filter_reviewed_anomalies, freshness_check, rescale_price_unit, strict_normalize
from ..operators.returns import build_portfolio
from ..session import materialize
from ..sources.bars import BAR_COLUMNS
from ..sources.commits import CommitLog
from ..sources.sinks import snapshot_manifest

#: For replays of history: a batch is judged at its own last session instead of at a point in time.
BATCH_END = "batch end"
UNIT = "price_unit"

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in BAR_COLUMNS])
BATCH = "batch_id"


class SessionStore:
    """Bars and portfolio returns below one shared folder, one folder of each per ingested batch.

    Folders are written once under fresh names; a commit file names those that count
    and makes the bars and the portfolio of a batch visible in one step.  A repeated
    batch takes the place of its former self, a failed one leaves nothing visible.
    Commits hold the last date of every folder, so old ones are not read for new sessions.
    """

    def __init__(self, spark: SparkSession, root: str, tickers: int, max_age: int = 4,
                 as_of: datetime | str | None = None, reviewed: DataFrame | None = None) -> None:
        """``as_of`` is the instant at which batches are judged (None: now); ``reviewed`` the known candle anomalies."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.tickers = tickers
        self.max_age = max_age
        self.as_of = as_of
        self.reviewed = reviewed
        self.log = CommitLog(spark, self.root)

    def _read(self, entries: dict[str, dict], schema: str) -> DataFrame:
        schema = f"{schema}, {BATCH} long"
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[x["path"] for x in entries.values()])

    def _entries(self, table: str) -> dict[str, dict]:
        return (self.log.read() or {}).get(table, {})

    def bars(self, before_batch: int | None = None, since: date | None = None) -> DataFrame:
        """Stored bars, without those of the given and later batches; with ``since`` only from that date on."""
        schema = "ticker string, date date, open double, high double, low double, close double, volume double"
        entries = self._entries("bars")
        if before_batch is not None:
            entries = {b: x for b, x in entries.items() if int(b) < before_batch}
        if since is not None:
            entries = {b: x for b, x in entries.items() if x["last"] >= since.isoformat()}
        stored = self._read(entries, schema).select(*BAR_COLUMNS)
        return stored if since is None else stored.filter(F.col("date") >= F.lit(since))

    def portfolio(self) -> DataFrame:
        """The latest return of each session: a late session changes the return of the one after it."""
        schema = "date date, portfolio_simple_return double, portfolio_log_return double"
        stored = self._read(self._entries("portfolio"), schema)
        return stored.groupBy("date").agg(
            *[F.max_by(c, BATCH).alias(c) for c in ("portfolio_simple_return", "portfolio_log_return")]
        )

    def manifest(self) -> DataFrame:
        """Rows, last date, extreme moves and content of every batch, by ticker and for its portfolio returns."""
        schema = f"entry string, rows long, last_date date, extreme_moves_flagged long, content string, {BATCH} long"
        entries = self._entries("manifest")
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[x["path"] for x in entries.values()])

    def excluded(self) -> DataFrame:
        """Reviewed anomalies that were left out, with the batch that brought them."""
        entries = self._entries("excluded")
        if not entries:
            raise LookupError("no batch left a reviewed anomaly out")
        return self.spark.read.parquet(*[x["path"] for x in entries.values()])

    def _write(self, rows: DataFrame, table: str, batch: int) -> tuple[DataFrame, dict]:
        path = self.log.fresh_folder(f"{table}/{BATCH}={batch}".replace("=", "-"))
        rows.withColumn(BATCH, F.lit(batch).cast("long")).write.mode("errorifexists").parquet(path)
        stored = self.spark.read.parquet(path)
        last = stored.agg(F.max("date")).first()[0] if "date" in stored.columns else None
        return stored.drop(BATCH), {"path": path, "last": last.isoformat() if last else ""}

    def _publish(self, batch: int, **folders: dict) -> None:
        """One commit for all tables of a batch."""
        now = self.log.read() or {}
        self.log.publish({table: now.get(table, {}) | {str(batch): entry} for table, entry in folders.items()})

    def seed(self, bars: DataFrame) -> None:
        """Start the store from a checked history (batch -1)."""
        stored, entry = self._write(bars.select(*BAR_COLUMNS), "bars", -1)
        returns, total = self._write(build_portfolio(stored, self.tickers), "portfolio", -1)
        _, listed = self._write(snapshot_manifest(stored, returns), "manifest", -1)
        self._publish(-1, bars=entry, portfolio=total, manifest=listed)

    def ingest(self, raw: DataFrame, batch: int) -> None:
        """Price unit, reviewed anomalies, strict clean, revision check, calendar and freshness gates; then append.

        Every gate is evaluated before the first write: a batch is published whole
        or not at all.  Dates are read as the cleaning reads them; an unreadable
        date, a session after the cutoff and a batch without rows are errors.  The
        cutoff is the last finished session at ``as_of``.  A batch with a ``price_unit``
        has its prices turned into thousands.  Candles that contradict themselves are
        left out if they are reviewed ones, and are errors otherwise.
        """
        raw = materialize(raw, "sessions-batch")
        day = parse_trading_date(F.col("date"))
        seen = raw.agg(
            F.count("*").alias("rows"), F.count_if(day.isNull()).alias("unreadable"), F.min(day).alias("first"),
            F.max(day).alias("last"),
            (F.max(day) if self.as_of == BATCH_END else eligible_session(F.lit(self.as_of) if self.as_of else F.current_timestamp())).alias("cutoff"),
        ).first()
        if not seen["rows"]:
            raise ValueError("a batch without rows")
        if seen["unreadable"]:
            raise ValueError(f"{seen['unreadable']} rows with an unreadable date")
        if seen["last"] > seen["cutoff"]:
            raise ValueError(f"session {seen['last']} is not finished at the cutoff {seen['cutoff']}")
        cutoff = F.lit(seen["cutoff"])
        raw, left_out = self._gated(raw)
        incoming = materialize(strict_normalize(raw, cutoff), "sessions-incoming")
        overlap = self.bars(before_batch=batch, since=seen["first"])
        revised = revised_rows(overlap, incoming).select("ticker", "field").limit(1).collect()
        if revised:
            raise ValueError(f"{revised[0]['ticker']}: the batch changes {revised[0]['field']} of a stored session")
        fresh = materialize(new_sessions(overlap, incoming), "sessions-fresh")
        if not calendar_mismatch(fresh, self.tickers).isEmpty():
            raise ValueError("trading dates of the new sessions are not aligned")
        behind = freshness_check(incoming, cutoff, self.max_age).filter(
            F.col("stale") | F.col("behind_others") | F.col("not_expected")
        )
        if not behind.isEmpty():
            raise ValueError("the expected session is missing for a required ticker")
        earliest = fresh.agg(F.min("date").alias("d")).first()["d"]
        if earliest is None:
            return
        # the session before the earliest new one gives its return; later stored sessions are rebuilt with it
        base = self.bars(before_batch=batch).filter(F.col("date") < F.lit(earliest)).agg(F.max("date").alias("d")).first()["d"]
        written, entry = self._write(fresh, "bars", batch)
        recent = self.bars(before_batch=batch, since=base or earliest).unionByName(written.select(*BAR_COLUMNS))
        returns, total = self._write(build_portfolio(recent, self.tickers), "portfolio", batch)
        _, listed = self._write(snapshot_manifest(written, returns), "manifest", batch)
        folders = {"bars": entry, "portfolio": total, "manifest": listed}
        if left_out is not None:
            folders["excluded"] = self._write(left_out, "excluded", batch)[1]
        self._publish(batch, **folders)

    def _gated(self, raw: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The batch in thousands and without reviewed anomalies, and these."""
        if UNIT in raw.columns:
            numbers = rescale_price_unit(raw.withColumns({c: coerce_numeric(F.col(c)) for c in PRICES}), UNIT)
            raw = materialize(numbers.drop(UNIT).withColumns({c: F.col(c).cast("string") for c in PRICES}), "sessions-batch")
        if self.reviewed is None:
            return raw, None
        typed = raw.select(
            "ticker", parse_trading_date(F.col("date")).alias("date"), *[coerce_numeric(F.col(c)).alias(c) for c in PRICES]
        )
        _, found = filter_reviewed_anomalies(typed, self.reviewed)
        found = materialize(found, "sessions-excluded")
        if found.isEmpty():
            return raw, None
        gone = found.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"))
        day = parse_trading_date(F.col("date"))
        return materialize(raw.join(gone, (F.col("ticker") == F.col("_t")) & (day == F.col("_d")), "left_anti"), "sessions-batch"), found


def ingest_sessions_stream(store: SessionStore, source: str, checkpoint: str, files_per_batch: int = 1) -> int:
    """Work off every waiting file of ``source`` and return the number of batches."""
    raw = (
        store.spark.readStream.schema(RAW_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(source)
    )
    done: list[int] = []

    def ingest(batch: DataFrame, number: int) -> None:
        store.ingest(batch, number)
        done.append(number)

    query = (
        raw.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(done)
