"""Raw text bars to clean bars: a lenient policy that drops and a strict one that raises.

Counts and de-duplication are aggregations with map-side partials, never windows
over raw rows: copies of one (ticker, date) may be arbitrarily many.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import coerce_numeric, eligible_session, finite, ordered_by, parse_trading_date

PRICES = ["open", "high", "low", "close"]
OHLCV = [*PRICES, "volume"]
REQUIRED = ["date", *OHLCV]


def normalized_name(name: str) -> str:
    return re.sub(r"[ -]", "_", str(name).strip().lower())


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim, lower-case and underscore the headers; ``time`` is accepted for ``date``."""
    names = [normalized_name(c) for c in df.columns]
    if "date" not in names:
        names = ["date" if n == "time" else n for n in names]
    if len(set(names)) != len(names):
        raise ValueError(f"columns collide after normalisation: {names}")
    return df.toDF(*names)


def require_columns(df: DataFrame, columns: Iterable[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def typed(raw: DataFrame) -> DataFrame:
    """Parsed date and numbers; what cannot be parsed is NULL."""
    keep = [c for c in raw.columns if c not in (*REQUIRED, "ticker")]
    return require_columns(raw, [*REQUIRED, "ticker"]).select(
        F.upper(F.trim("ticker")).alias("ticker"), *keep, parse_trading_date(F.col("date")).alias("date"), *[coerce_numeric(F.col(c)).alias(c) for c in OHLCV]
    )


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def incomplete() -> Column:
    return any_of(F.col(c).isNull() for c in REQUIRED)


def has_bad_price() -> Column:
    return F.coalesce(any_of(F.coalesce(F.col(c) <= 0, F.lit(False)) for c in PRICES), F.lit(False))


def has_negative_volume() -> Column:
    return F.coalesce(F.col("volume") < 0, F.lit(False))


def breaks_ohlc() -> Column:
    """Any of the high/low inequalities fails; comparisons with a missing side do not count."""
    high, low = F.col("high"), F.col("low")
    tests = [high < F.col("open"), high < low, high < F.col("close"), low > F.col("open"), low > F.col("close")]
    return any_of(F.coalesce(t, F.lit(False)) for t in tests)


def session_state(raw: DataFrame) -> DataFrame:
    """One row per (ticker, date): fault counts of all copies and the last valid copy in file order.

    Everything the cleaning and the report need from the raw rows, in one pass
    with map-side partials.
    """
    valid = ~incomplete() & ~has_bad_price() & ~has_negative_volume()
    return (
        typed(raw)
        .groupBy("ticker", "date")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(incomplete()).alias("missing"),
            F.count_if(has_bad_price()).alias("bad_price"),
            F.count_if(has_negative_volume()).alias("negative_volume"),
            F.min("ordinal").alias("first_seen"),
            F.max("ordinal").alias("last_seen"),
            F.count_if(valid).alias("kept"),
            *[F.max_by(F.when(valid, F.col(c)), F.when(valid, F.col("ordinal"))).alias(c) for c in OHLCV],
        )
    )


def earlier_dates() -> WindowSpec:
    return ordered_by("ticker").rowsBetween(Window.unboundedPreceding, -1)


def with_seen_before(state: DataFrame) -> DataFrame:
    """Add the file position reached by all earlier dates.

    Dates are in order exactly when, walking them upwards, every date's first row
    comes after the last row of all earlier dates.
    """
    dated = F.when(F.col("date").isNotNull(), F.col("last_seen"))
    return state.withColumn("_seen_before", F.max(dated).over(earlier_dates()))


def structural_counts() -> list[Column]:
    dated = F.col("date").isNotNull()
    disordered = F.coalesce(dated & (F.col("_seen_before") > F.col("first_seen")), F.lit(False))
    return [
        F.sum("rows").alias("raw_rows"),
        F.sum(F.when(~dated, F.col("rows")).otherwise(0)).alias("date_parse_failures"),
        F.sum("missing").alias("missing_rows"),
        F.sum(F.when(dated & (F.col("rows") > 1), F.col("rows")).otherwise(0)).alias("duplicate_date_rows"),
        F.sum("bad_price").alias("nonpositive_price_rows"),
        F.sum("negative_volume").alias("negative_volume_rows"),
        F.bool_or(disordered).alias("dates_out_of_order"),
    ]


def structural_diagnostics(raw: DataFrame) -> DataFrame:
    """Counts of structural faults per ticker, with every copy of a repeated date counted."""
    return with_seen_before(session_state(raw)).groupBy("ticker").agg(*structural_counts())


def keep_last_per_date(rows: DataFrame, columns: Sequence[str] = tuple(OHLCV)) -> DataFrame:
    """The row that comes last in file order, by aggregation."""
    return rows.groupBy("ticker", "date").agg(*[F.max_by(c, "ordinal").alias(c) for c in columns])


def clean_structural(raw: DataFrame) -> DataFrame:
    """Drop incomplete, non-positive and negative-volume rows; keep the last row of a date."""
    return session_state(raw).filter(F.col("kept") > 0).select("ticker", *REQUIRED)


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Rows that break an OHLC inequality."""
    return bars.filter(breaks_ohlc())


def ohlc_violation_summary(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.count_if(breaks_ohlc()).alias("invalid_ohlc_rows"),
        F.min(F.when(breaks_ohlc(), F.col("date"))).alias("first_invalid"),
        F.max(F.when(breaks_ohlc(), F.col("date"))).alias("last_invalid"),
    )


def drop_invalid_ohlc(bars: DataFrame) -> DataFrame:
    return bars.filter(~breaks_ohlc())


def flag_extreme_moves(bars: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Sessions whose close moved by more than the threshold; flagged, never removed."""
    from .returns import simple_return

    return (
        simple_return(bars)
        .filter(F.abs("simple_return") > threshold)
        .select("ticker", "date", "close", F.col("simple_return").alias("close_change"))
    )


def lenient_normalize(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean bars and diagnostics under the dropping policy, OHLC order included."""
    rows = typed(raw)
    ordered = F.coalesce(
        (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close")),
        F.lit(False),
    )
    valid = ~incomplete() & ~has_bad_price() & ~has_negative_volume() & ordered
    clean = keep_last_per_date(rows.filter(valid))
    per_date = rows.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(incomplete()).alias("missing"),
        F.count_if(~ordered).alias("invalid"),
        F.count_if(valid).alias("kept"),
    )
    diagnostics = per_date.groupBy("ticker").agg(
        F.sum("rows").alias("raw_rows"),
        F.count_if(F.col("kept") > 0).alias("clean_rows"),
        F.sum("missing").alias("missing_rows_before_cleaning"),
        F.sum(F.when(F.col("rows") > 1, F.col("rows")).otherwise(0)).alias("duplicate_dates_before_cleaning"),
        F.sum("invalid").alias("invalid_ohlc_rows"),
        F.min(F.when(F.col("kept") > 0, F.col("date"))).alias("start_date"),
        F.max(F.when(F.col("kept") > 0, F.col("date"))).alias("end_date"),
    )
    return clean, diagnostics


STRICT_RULES = [
    "invalid_date", "duplicate_dates", "not_finite", "nonpositive_price", "negative_volume", "invalid_ohlc",
]


def strict_violations(raw: DataFrame, cutoff: Column) -> DataFrame:
    """Per ticker: rows up to the cutoff and how many break each rule of the raising policy."""
    rows = typed(raw).filter(F.col("date").isNull() | (F.col("date") <= cutoff))
    bad_number = any_of(~finite(F.col(c)) for c in OHLCV)
    per_date = rows.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad_number).alias("not_finite"),
        F.count_if(has_bad_price()).alias("nonpositive_price"),
        F.count_if(has_negative_volume()).alias("negative_volume"),
        F.count_if(breaks_ohlc()).alias("invalid_ohlc"),
    )
    dated = F.col("date").isNotNull()
    return per_date.groupBy("ticker").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(~dated, F.col("rows")).otherwise(0)).alias("invalid_date"),
        F.count_if(dated & (F.col("rows") > 1)).alias("duplicate_dates"),
        *[F.sum(c).alias(c) for c in ("not_finite", "nonpositive_price", "negative_volume", "invalid_ohlc")],
    )


def strict_normalize(raw: DataFrame, cutoff: Column) -> DataFrame:
    """Typed bars up to the cutoff; any violation raises before a row is returned."""
    broken = (
        strict_violations(raw, cutoff)
        .filter(any_of(F.col(rule) > 0 for rule in STRICT_RULES))
        .orderBy("ticker")
        .limit(1)
        .collect()
    )
    if broken:
        found = {rule: broken[0][rule] for rule in STRICT_RULES if broken[0][rule]}
        raise ValueError(f"{broken[0]['ticker']}: {found}")
    return typed(raw).filter(F.col("date") <= cutoff).select("ticker", *REQUIRED)


def eligible_sessions(instants: DataFrame, instant: str, closed: DataFrame) -> DataFrame:
    """Latest finished session of each instant; instants that fall on a closed date are dropped."""
    return instants.withColumn("session", eligible_session(F.col(instant))).join(
        closed.select(F.col("date").alias("session")), "session", "left_anti"
    )


def rescale_price_unit(bars: DataFrame, unit: str = "price_unit", stocks: Column | None = None) -> DataFrame:
    """Prices in single currency units become thousands; points and thousands stay."""
    source = F.col(unit)
    allowed = source.isNull() | source.isin("vnd", "thousand_vnd", "index_points")
    stock = F.lit(True) if stocks is None else stocks
    guard = F.when(allowed & ((source != "vnd") | source.isNull() | stock), F.lit(1.0)).otherwise(
        F.raise_error(F.concat(F.lit("unsupported price unit for "), F.col("ticker"))).cast("double")
    )
    factor = F.when(source == "vnd", F.lit(1000.0)).otherwise(F.lit(1.0)) * guard
    return bars.withColumns({c: F.col(c) / factor for c in PRICES})


def freshness_check(bars: DataFrame, cutoff: Column, max_age: int = 4) -> DataFrame:
    """Last session of every ticker: stale, different from the others, or not the expected one.

    Compares one pre-aggregated row per ticker.
    """
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    everyone = Window.partitionBy(F.lit(1))
    return last.select(
        "ticker",
        "last_date",
        (F.col("last_date") < F.date_sub(cutoff, max_age)).alias("stale"),
        (F.col("last_date") != F.max("last_date").over(everyone)).alias("behind_others"),
        (F.col("last_date") != cutoff).alias("not_expected"),
    )


def anomaly_gaps(bars: DataFrame, cutoff: Column | None = None, tolerance: float = 1e-8) -> DataFrame:
    """Sessions whose high or low is crossed by another price, and by how much."""
    high_gap = F.greatest(F.greatest("open", "low", "close") - F.col("high"), F.lit(0.0))
    low_gap = F.greatest(F.col("low") - F.least("open", "high", "close"), F.lit(0.0))
    rows = bars if cutoff is None else bars.filter(F.col("date") <= cutoff)
    return rows.select(
        "ticker", "date", *PRICES, high_gap.alias("high_gap"), low_gap.alias("low_gap"),
        F.greatest(high_gap, low_gap).alias("max_gap_points"),
    ).filter(F.col("max_gap_points") > tolerance)


def review_anomalies(bars: DataFrame, reviewed: DataFrame, cutoff: Column | None = None,
                     tolerance: float = 0.02) -> DataFrame:
    """Anomalies with ``reviewed`` true when a reviewed entry has the same gap."""
    known = reviewed.select("ticker", "date", F.col("gap").alias("_gap"))
    return (
        anomaly_gaps(bars, cutoff)
        .join(known, ["ticker", "date"], "left")
        .withColumn(
            "reviewed", F.coalesce(F.abs(F.col("max_gap_points") - F.col("_gap")) <= tolerance, F.lit(False))
        )
        .drop("_gap")
    )


def filter_reviewed_anomalies(bars: DataFrame, reviewed: DataFrame, cutoff: Column | None = None,
                              tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Bars without the reviewed anomalies, and the excluded rows; any other anomaly is an error."""
    found = review_anomalies(bars, reviewed, cutoff, tolerance)
    unknown = found.filter(~F.col("reviewed")).orderBy("date").limit(1).collect()
    if unknown:
        raise ValueError(f"unreviewed OHLC anomaly on {unknown[0]['date']} (gap={unknown[0]['max_gap_points']:.4f})")
    return bars.join(found.select("ticker", "date"), ["ticker", "date"], "left_anti"), found.drop("reviewed")


AUDIT_VALUES = [*PRICES, "high_gap", "low_gap", "max_gap_points"]


def audit_spread(old: DataFrame, current: DataFrame) -> DataFrame:
    """One row per audited date with the widest disagreement of its copies."""
    spread = F.greatest(*[F.max(c) - F.min(c) for c in AUDIT_VALUES], F.lit(0.0))
    merged = old.withColumn("_age", F.lit(0)).unionByName(current.withColumn("_age", F.lit(1)))
    return merged.groupBy("ticker", "date").agg(
        *[F.min_by(c, "_age").alias(c) for c in AUDIT_VALUES],
        F.count(F.lit(1)).alias("copies"),
        spread.alias("spread"),
    )


def reconcile_anomaly_audit(old: DataFrame, current: DataFrame, tolerance: float = 1e-7,
                            check: bool = True) -> DataFrame:
    """Union of two audits, one row per date; a changed candle is an error."""
    merged = audit_spread(old, current)
    if check and not merged.filter(F.col("spread") > tolerance).isEmpty():
        raise ValueError("reviewed historical candle changed")
    return merged


PERIOD_MONTHS: Mapping[str, int] = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12}


def filter_period(bars: DataFrame, period: str) -> DataFrame:
    """Rows of each ticker from the period start, counted back from its last date."""
    if period == "All":
        return bars
    last = F.col("_last")
    if period == "YTD":
        start = F.trunc(last, "year")
    elif period in PERIOD_MONTHS:
        start = F.add_months(last, -PERIOD_MONTHS[period])
    else:
        raise ValueError(f"unsupported period: {period}")
    ends = bars.groupBy("ticker").agg(F.max("date").alias("_last"))
    return bars.join(ends, "ticker").filter(F.col("date") >= start).drop("_last")


def availability_matrix(bars: DataFrame, symbols: Sequence[str], audit: DataFrame,
                        calendar: DataFrame | None = None) -> DataFrame:
    """absent / valid / excluded / invalid for every session and symbol.

    The symbol list is a parameter, so each session is expanded by one explode.
    """
    sessions = bars.select("date").distinct() if calendar is None else calendar.select("date").distinct()
    grid = sessions.withColumn("ticker", F.explode(F.array(*[F.lit(s) for s in symbols])))
    sound = (
        ~any_of(~finite(F.col(c)) for c in OHLCV) & ~has_bad_price() & ~has_negative_volume() & ~breaks_ohlc()
    )
    states = bars.groupBy("ticker", "date").agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("_sound"))
    excluded = audit.select("ticker", "date", F.lit(True).alias("_excluded")).distinct()
    return (
        grid.join(states, ["ticker", "date"], "left")
        .join(excluded, ["ticker", "date"], "left")
        .select(
            "date",
            "ticker",
            F.when(F.col("_sound"), "valid")
            .when(F.col("_sound").isNotNull(), "invalid")
            .when(F.col("_excluded"), "excluded")
            .otherwise("absent")
            .alias("state"),
        )
    )


def return_quality(returns: DataFrame) -> DataFrame:
    """Counts of valid, missing, infinite and out-of-domain returns per ticker."""
    columns = [F.count(F.lit(1)).alias("observations")]
    for name in ("simple_return", "log_return"):
        value = F.col(name)
        columns += [
            F.count(value).alias(f"valid_{name}s"),
            F.count_if(value.isNull()).alias(f"missing_{name}s"),
            F.count_if(value == F.lit(float("inf"))).alias(f"positive_inf_{name}s"),
            F.count_if(value == F.lit(float("-inf"))).alias(f"negative_inf_{name}s"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    return returns.groupBy("ticker").agg(
        *columns, F.count_if(F.col("simple_return") <= -1.0).alias("invalid_log_domain")
    )
