from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tailgauge.session import scratch_path
from tailgauge.sources.bars import packed_order, read_market_snapshot, read_ohlcv_csv, scan_panel, tick_bars
from tailgauge.sources.predictions import read_predictions
from tailgauge.sources.registry import get_forecast, judge_forecasts, register_forecasts
from tailgauge.sources.commits import CommitLog
from tailgauge.sources.sinks import read_prediction_set, snapshot_manifest, write_prediction_set, write_snapshot
from tailgauge.streaming.sessions import BATCH_END, SessionStore, ingest_sessions_stream

FORECAST = (
    "forecast_id string, model_name string, model_version string, generated_at timestamp, data_as_of_date date, "
    "target_date date, quantile_alpha double, quantile_return double, training_start date, training_end date, "
    "feature_version string, config_hash string, data_hash string, git_commit string"
)
BASE = dict(
    forecast_id="f1", model_name="m", model_version="v1", generated_at=datetime(2024, 1, 10, 11),
    data_as_of_date=date(2024, 1, 10), target_date=date(2024, 1, 11), quantile_alpha=0.05, quantile_return=-0.02,
    training_start=date(2020, 1, 1), training_end=date(2024, 1, 10), feature_version="7f", config_hash="A" * 64,
    data_hash="b" * 64, git_commit="c" * 40,
)


def forecasts(spark, *changes):
    rows = [{**BASE, "forecast_id": f"f{i}", **c} for i, c in enumerate(changes)]
    names = [p.strip().split()[0] for p in FORECAST.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FORECAST)


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"model_name": "  "}, "labels"),
        ({"training_end": date(2024, 1, 11)}, "chronology"),
        ({"data_as_of_date": date(2024, 1, 11)}, "chronology"),
        ({"generated_at": datetime(2024, 1, 10, 17)}, "made_before_target"),  # already the target day locally
        ({"quantile_alpha": 0.01}, "alpha"),
        ({"quantile_return": -1.5}, "quantile"),
        ({"quantile_return": float("nan")}, "quantile"),
        ({"git_commit": "xyz"}, "hashes"),
    ],
)
def test_registration_rules(spark, change, reason):
    assert judge_forecasts(None, forecasts(spark, change)).first().rejected_for == reason


def test_registry_is_append_only(spark):
    path, rejects = scratch_path(spark, "registry"), scratch_path(spark, "rejects")
    register_forecasts(spark, path, forecasts(spark, {}), rejects)
    changed = forecasts(spark, {"forecast_id": "again", "quantile_return": -0.9}, {"target_date": date(2024, 1, 12)})
    stored = register_forecasts(spark, path, changed, rejects)
    assert stored.count() == 2 and spark.read.parquet(rejects).first().rejected_for == "duplicate_key"
    first = get_forecast(stored, "f0").first()
    assert first["quantile_return"] == -0.02 and first["var_return"] == 0.02 and first["status"] == "PENDING"
    assert first["config_hash"] == "a" * 64
    with pytest.raises(LookupError):
        get_forecast(stored, "again")
    with pytest.raises(ValueError, match="duplicate_key"):
        register_forecasts(spark, path, changed)


def test_copies_inside_one_batch(spark):
    rows = judge_forecasts(None, forecasts(spark, {}, {})).orderBy("forecast_id").collect()
    assert [r.rejected_for for r in rows] == [None, "duplicate_key"]


def test_snapshots_are_never_overwritten(spark, panel):
    path = scratch_path(spark, "snap")
    assert write_snapshot(panel, path).count() == 120
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_snapshot(panel, path)
    stored = write_prediction_set({"bars": panel, "some": panel.limit(3)}, scratch_path(spark, "set"), {"bars": ["ticker"]})
    assert stored["bars"].count() == 120 and stored["some"].count() == 3


def test_fingerprint_ignores_order_and_sees_changes(spark, panel):
    total = panel.select("date", F.col("close").alias("ret"))
    key = lambda d: {r.entry: r.content for r in snapshot_manifest(d, total).collect()}
    base = key(panel)
    assert key(panel.orderBy(F.desc("date"))) == base
    changed = key(panel.withColumn("close", F.when(F.col("ticker") == "AAA", F.col("close") + 1).otherwise(F.col("close"))))
    assert changed["AAA"] != base["AAA"] and changed["BBB"] == base["BBB"]


def test_candles_from_trades(spark):
    rows = [("x", "2024-01-02 10:00:00", 2, 12.0, 2.0), ("x", "2024-01-02 10:00:00", 1, 10.0, 1.0),
            ("x", "2024-01-02 11:00:00", 3, 9.0, 1.0), ("x", "2024-01-03 09:00:00", 4, 8.0, 5.0)]
    df = spark.createDataFrame(rows, "s string, t string, id long, p double, q double").withColumn("t", F.col("t").cast("timestamp"))
    order = packed_order(F.unix_micros("t"), "id")
    args = dict(ticker=F.col("s"), date=F.to_date("t"), price=F.col("p"), quantity=F.col("q"), order=order)
    first = tick_bars(df, **args).orderBy("date").first()
    assert (first.open, first.high, first.low, first.close, first.volume) == (10.0, 12.0, 9.0, 9.0, 4.0)
    assert tick_bars(df, **args, close="vwap").orderBy("date").first().close == pytest.approx(43 / 4)


def test_file_order_is_kept(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text("ticker,date,open,high,low,close,volume\n" + "\n".join(f"a,2024-01-02,1,1,1,{i},1" for i in range(50)))
    df = read_ohlcv_csv(spark, str(file), ["ticker", "date", "open", "high", "low", "close", "volume"])
    assert df.agg(F.max_by("close", "ordinal")).first()[0] == "49"
    assert df.first().source_file.endswith("a.csv")


def test_snapshot_guards(spark, panel):
    assert read_market_snapshot(panel.withColumn("ticker", F.lower("ticker")), ["AAA", "BBB"]).count() == 120
    with pytest.raises(ValueError, match="missing tickers"):
        read_market_snapshot(panel, ["AAA", "ZZZ"])
    with pytest.raises(ValueError, match="missing values"):
        read_market_snapshot(panel.withColumn("volume", F.lit("x")), ["AAA"])
    with pytest.raises(ValueError, match="expected columns"):
        scan_panel([panel, panel.drop("volume")])


def test_prediction_file_flags(spark, tmp_path):
    head = "series_id,method,as_of,target_date,actual_return,quantile_return,var,violation\n"
    good = tmp_path / "good.csv"
    good.write_text(head + "s,m,2024-01-01,2024-01-02,0.1,-0.2,0.2, FALSE \n")
    assert read_predictions(spark, str(good)).first().violation is False
    bad = tmp_path / "bad.csv"
    bad.write_text(head + "s,m,2024-01-01,2024-01-02,0.1,-0.2,0.2,maybe\n")
    with pytest.raises(ValueError, match="unreadable"):
        read_predictions(spark, str(bad))


@pytest.fixture()
def store(spark, panel):
    root = scratch_path(spark, "sessions")
    made = SessionStore(spark, f"{root}/store", 3, as_of=BATCH_END)
    made.seed(panel.filter(F.col("date") <= "2020-02-07"))
    return made


def arrive(store, rows):
    text = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns])
    text.coalesce(1).write.mode("append").option("header", True).csv(f"{store.root}/incoming")
    ingest_sessions_stream(store, f"{store.root}/incoming", f"{store.root}/checkpoint")


def test_stream_appends_new_sessions_batch_by_batch(spark, panel, store):
    for first, last in (("2020-01-30", "2020-02-14"), ("2020-02-10", "2020-02-28")):
        arrive(store, panel.filter(F.col("date").between(first, last)))
    assert store.bars().exceptAll(panel).isEmpty() and panel.exceptAll(store.bars()).isEmpty()
    assert store.portfolio().count() == 39
    before = store.bars().count()
    store.ingest(panel.filter(F.col("date") > "2020-02-10").select([F.col(c).cast("string").alias(c) for c in panel.columns]), 1)
    assert store.bars().count() == before and store.portfolio().count() == 39  # a repeated batch leaves no copies


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda d: d.withColumn("close", F.when(F.col("date") == "2020-02-05", F.col("close") + 0.5).otherwise(F.col("close"))),
         "of a stored session"),
        (lambda d: d.filter((F.col("ticker") != "BBB") | (F.col("date") < "2020-02-12")), "not aligned|expected session"),
        (lambda d: d.withColumn("volume", F.lit(-1.0)), "negative_volume"),
        (lambda d: d.unionByName(d.limit(1)), "duplicate_dates"),
    ],
)
def test_a_bad_batch_publishes_nothing(spark, panel, store, change, message):
    bad = change(panel.filter(F.col("date").between("2020-02-03", "2020-02-14")))
    bars, portfolio = store.bars().count(), store.portfolio().count()
    with pytest.raises(Exception, match=message):
        arrive(store, bad)
    assert store.bars().count() == bars and store.portfolio().count() == portfolio


def as_text(rows, day="yyyy-MM-dd"):
    return rows.select([F.date_format(c, day).alias(c) if c == "date" else F.col(c).cast("string").alias(c) for c in rows.columns])


@pytest.mark.parametrize("day", ["yyyy/MM/dd", "MM/dd/yyyy"])
def test_other_date_spellings_are_stored(panel, store, day):
    store.ingest(as_text(panel.filter(F.col("date").between("2020-02-03", "2020-02-14")), day), 0)
    assert store.bars().filter("date <= '2020-02-14'").exceptAll(panel).isEmpty()
    assert store.bars().agg(F.max("date").cast("string")).first()[0] == "2020-02-14"


def test_evening_stamps_belong_to_the_next_session(panel, store):
    rows = panel.filter(F.col("date").between("2020-02-11", "2020-02-14"))
    store.ingest(as_text(rows.withColumn("date", F.date_sub("date", 1)), "yyyy-MM-dd 20:00:00"), 0)
    assert store.bars().filter("date >= '2020-02-11'").count() == rows.count()


def test_unreadable_dates_empty_batches_and_open_sessions_are_refused(spark, panel, store):
    from datetime import datetime

    rows = as_text(panel.filter(F.col("date").between("2020-02-03", "2020-02-14")))
    with pytest.raises(ValueError, match="unreadable date"):
        store.ingest(rows.withColumn("date", F.when(F.col("ticker") == "AAA", "soon").otherwise(F.col("date"))), 0)
    with pytest.raises(ValueError, match="without rows"):
        store.ingest(rows.limit(0), 0)
    late = SessionStore(spark, store.root, 3, as_of=datetime(2020, 2, 13, 3))
    with pytest.raises(ValueError, match="not finished"):
        late.ingest(rows, 0)
    assert store.bars().agg(F.max("date").cast("string")).first()[0] == "2020-02-07"


def test_a_late_session_corrects_the_return_after_it(panel, store):
    days = panel.filter(F.col("date").between("2020-02-10", "2020-02-14"))
    store.ingest(as_text(days.filter("date != '2020-02-12'")), 0)
    store.ingest(as_text(days.filter("date >= '2020-02-12'")), 1)
    whole = SessionStore(panel.sparkSession, scratch_path(panel.sparkSession, "sessions"), 3)
    whole.seed(panel.filter("date <= '2020-02-14'"))
    assert store.portfolio().exceptAll(whole.portfolio()).isEmpty()
    assert store.portfolio().count() == whole.portfolio().count()


def test_files_with_other_column_order_are_refused(spark, tmp_path):
    file = tmp_path / "swapped.csv"
    file.write_text("ticker,date,close,high,low,open,volume\na,2024-01-02,1,2,3,4,5\n")
    with pytest.raises(Exception, match="header|schema"):
        read_ohlcv_csv(spark, str(file), ["ticker", "date", "open", "high", "low", "close", "volume"]).collect()


def test_equal_rows_and_known_ids_are_registered_once(spark):
    same = judge_forecasts(None, forecasts(spark, {}, {}).withColumn("forecast_id", F.lit("one"))).collect()
    assert sorted(r.rejected_for or "" for r in same) == ["", "duplicate_key"]
    stored = forecasts(spark, {}).withColumn("forecast_id", F.lit("one"))
    other = forecasts(spark, {}).withColumns({"forecast_id": F.lit("one"), "model_version": F.lit("v9")})
    assert [r.rejected_for for r in judge_forecasts(stored, other).collect()] == ["duplicate_key"]


def test_portfolios_refuse_gaps_and_total_losses(panel):
    from tailgauge.operators.returns import build_portfolio

    with pytest.raises(ValueError, match="calendars differ"):
        build_portfolio(panel.filter("ticker != 'AAA' OR date != '2020-01-08'"), 3)
    with pytest.raises(ValueError, match="portfolio return"):
        build_portfolio(panel.withColumn("close", F.when(F.col("date") == "2020-01-08", -500.0).otherwise(F.col("close"))), 3)


def test_a_session_counts_tickers_not_rows(panel):
    from tailgauge.operators.alignment import align_calendars

    twice = panel.filter("date != '2020-01-08' OR ticker != 'CCC'").unionByName(panel.filter("date = '2020-01-08' AND ticker = 'AAA'"))
    assert align_calendars(twice, 3).filter("date = '2020-01-08'").isEmpty()


def test_written_tables_can_be_discarded(spark):
    from tailgauge.session import discard, materialize

    table = materialize(spark.range(5).toDF("n"), "short-lived")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(table)
    assert not __import__("os").path.exists(folder)


def test_a_row_is_lost_only_to_an_accepted_rival(spark):
    cases = [("A", "K1"), ("A", "K2"), ("B", "K2"), ("C", "K2"), ("C", "K3"), ("C", "K3"), ("D", "K1"), ("E", "K4")]
    batch = forecasts(spark, *[{"forecast_id": i, "model_name": k} for i, k in cases]).repartition(3)
    got = sorted((r.forecast_id, r.model_name) for r in judge_forecasts(None, batch).filter("rejected_for IS NULL").collect())
    assert got == [("A", "K1"), ("B", "K2"), ("C", "K3"), ("E", "K4")]
    stored = forecasts(spark, {"forecast_id": "B", "model_name": "K9"})
    got = sorted((r.forecast_id, r.model_name) for r in judge_forecasts(stored, batch).filter("rejected_for IS NULL").collect())
    assert got == [("A", "K1"), ("C", "K2"), ("E", "K4")]  # B is known, so C gets K2 and has no other


def test_forecasts_need_an_id(spark):
    rows = forecasts(spark, {"forecast_id": None}, {"forecast_id": None, "model_name": "k"}, {"forecast_id": " ", "model_name": "l"})
    assert [r.rejected_for for r in judge_forecasts(None, rows).collect()] == ["identity"] * 3


def test_a_batch_that_fails_before_its_commit_can_be_repeated(spark, monkeypatch):
    path, rejects = scratch_path(spark, "registry"), scratch_path(spark, "rejects")
    batch = forecasts(spark, {}, {"model_name": " "})
    writer = type(batch.write)
    plain = writer.parquet

    def failing(self, target, *args, **kwargs):
        if target == path:
            raise OSError("disk")
        return plain(self, target, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(OSError):
        register_forecasts(spark, path, batch, rejects)
    monkeypatch.setattr(writer, "parquet", plain)
    assert [r.forecast_id for r in register_forecasts(spark, path, batch, rejects).collect()] == ["f0"]


def test_fingerprint_counts_repeated_rows(spark, panel):
    total = panel.select("date", F.col("close").alias("ret"))
    key = lambda d: {r.entry: r.content for r in snapshot_manifest(d, total).collect()}
    one = panel.filter("ticker = 'AAA' AND date = '2020-01-08'")
    assert len({key(panel)["AAA"], key(panel.unionByName(one))["AAA"], key(panel.unionByName(one).unionByName(one))["AAA"]}) == 3
    gone = panel.withColumn("open", F.when(F.col("date") != "2020-01-08", F.col("open")))
    assert key(gone)["BBB"] != key(panel)["BBB"]


def test_a_set_is_visible_whole_or_not_at_all(spark, panel):
    where = scratch_path(spark, "set")
    write_snapshot(panel, f"{where}/bars")  # what a run that failed half-way leaves
    with pytest.raises(LookupError):
        read_prediction_set(spark, where)
    where = scratch_path(spark, "set")
    write_prediction_set({"bars": panel, "few": panel.limit(3)}, where, {"bars": ["ticker"]})
    found = read_prediction_set(spark, where)
    assert found["bars"].count() == 120 and found["few"].count() == 3 and found["bars"].exceptAll(panel.select(found["bars"].columns)).isEmpty()
    with pytest.raises(ValueError, match="already"):
        write_prediction_set({"bars": panel}, where)


def test_commits_are_numbered_and_never_replaced(spark):
    log = CommitLog(spark, scratch_path(spark, "log"))
    assert log.read() is None and [log.publish({"a": 1}), log.publish({"a": 2})] == [1, 2]
    assert log.read() == {"a": 2} and log.read(1) == {"a": 1}
    late = CommitLog(spark, log.root)
    late.versions = lambda: [1]  # a writer that has not seen the second commit
    with pytest.raises(RuntimeError, match="someone else"):
        late.publish({"a": 3})
    assert log.read() == {"a": 2}


def test_bars_and_portfolio_appear_together(panel, store, monkeypatch):
    rows = as_text(panel.filter(F.col("date").between("2020-02-10", "2020-02-14")))
    before = (store.bars().count(), store.portfolio().count())
    import tailgauge.streaming.sessions as module

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(module, "build_portfolio", broken)
        with pytest.raises(OSError):
            store.ingest(rows, 0)
    assert (store.bars().count(), store.portfolio().count()) == before
    store.ingest(rows, 0)
    assert store.bars().agg(F.max("date").cast("string")).first()[0] == "2020-02-14"
    assert store.portfolio().agg(F.max("date").cast("string")).first()[0] == "2020-02-14"
    assert store.bars(since=date(2020, 2, 10)).inputFiles() and all("batch_id-0" in f for f in store.bars(since=date(2020, 2, 10)).inputFiles())


def test_a_repeated_bar_is_refused(panel):
    from tailgauge.operators.returns import build_portfolio

    with pytest.raises(ValueError, match="2 bars of AAA on 2020-01-08"):
        build_portfolio(panel.unionByName(panel.filter("ticker = 'AAA' AND date = '2020-01-08'")), 3)


def test_prices_in_single_units_become_thousands(panel, store):
    rows = panel.filter(F.col("date").between("2020-02-10", "2020-02-14"))
    vnd = rows.withColumns({c: F.col(c) * 1000 for c in ("open", "high", "low", "close")}).withColumn("price_unit", F.lit("vnd"))
    with pytest.raises(Exception, match="unsupported price unit"):
        store.ingest(as_text(vnd.withColumn("price_unit", F.lit("usd"))), 0)
    store.ingest(as_text(vnd), 0)
    got = store.bars(since=date(2020, 2, 10))
    assert got.exceptAll(rows.select(got.columns)).isEmpty() and got.count() == rows.count()


def test_reviewed_anomalies_are_left_out_and_others_refused(spark, panel, store):
    days = panel.filter(F.col("date").between("2020-02-10", "2020-02-14"))
    broken = days.withColumn("high", F.when(F.col("date") == "2020-02-12", F.col("close") - 1).otherwise(F.col("high")))
    judged = SessionStore(spark, store.root, 3, as_of=BATCH_END, reviewed=spark.createDataFrame([], "ticker string, date date, gap double"))
    with pytest.raises(ValueError, match="unreviewed"):
        judged.ingest(as_text(broken), 0)
    gap = [(t, date(2020, 2, 12), 1.0) for t in ("AAA", "BBB", "CCC")]
    judged.reviewed = spark.createDataFrame(gap, "ticker string, date date, gap double")
    judged.ingest(as_text(broken), 0)
    assert store.bars().filter("date = '2020-02-12'").isEmpty() and judged.excluded().count() == 3
    rows = {r.entry: r.rows for r in store.manifest().filter("batch_id = 0").collect()}
    assert rows == {"AAA": 4, "BBB": 4, "CCC": 4, "portfolio": 4}


def test_without_an_instant_a_batch_is_judged_now(spark, panel, store):
    now = SessionStore(spark, store.root, 3)
    with pytest.raises(ValueError, match="expected session is missing"):
        now.ingest(as_text(panel.filter(F.col("date").between("2020-02-10", "2020-02-14"))), 0)
