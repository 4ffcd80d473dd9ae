"""Snapshots and prediction sets, published once and never overwritten."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from .commits import CommitLog


#: Binary places that count: a product with a power of two and its floor are exact in every engine.
BAR_BITS, RETURN_BITS = 24, 30


def content_check(columns: Sequence[str]) -> Column:
    """Order-independent sum of row hashes: a repeated row counts as often as it occurs."""
    return F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(20,0)"))


def canonical(name: str, kind: DataType, bits: int) -> Column:
    """A value as text that other engines can print too; its length goes with it, NULL is ``~``."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (DoubleType, FloatType)):
        text = F.floor(value.cast("double") * 2.0**bits).cast("string")
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def fingerprint(df: DataFrame, columns: Sequence[str], bits: int = BAR_BITS) -> Column:
    """Content of a group of rows, whatever their order: sums of both halves of the rows' md5 digests.

    Equal rows add up instead of cancelling.  Floating columns count in steps of
    2**-bits (up to 2**(63 - bits)), so that engines whose last bits differ agree; the
    SQL form is :func:`fingerprint_sql`.
    """
    digest = F.md5(F.concat_ws("|", *[canonical(c, df.schema[c].dataType, bits) for c in columns]))
    half = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17)]
    return F.concat_ws("-", *half)


def fingerprint_sql(columns: Mapping[str, str], bits: int = BAR_BITS) -> str:
    """The same in SQL; ``columns`` maps names to ``double`` or ``text``."""
    texts = {
        c: f"CAST(CAST(floor({c} * {2**bits}) AS BIGINT) AS VARCHAR)" if kind == "double" else f"CAST({c} AS VARCHAR)" for c, kind in columns.items()
    }
    parts = ", ".join(f"coalesce(length({t}) || ':' || {t}, '~')" for t in texts.values())
    half = [f"CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {parts})), {at}, 15) AS HUGEINT)) AS VARCHAR)" for at in (1, 17)]
    return f"{half[0]} || '-' || {half[1]}"


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a new Parquet snapshot and read it back; rows and content must agree.

    The job commit publishes all files at once; an existing path is an error.
    """
    seen = [F.count(F.lit(1)).alias("rows"), content_check(df.columns).alias("content")]
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    if df.agg(*seen).first() != stored.select(*df.columns).agg(*seen).first():
        raise RuntimeError(f"snapshot {path} differs from its source")
    return stored


def write_prediction_set(tables: Mapping[str, DataFrame], directory: str,
                         partition_by: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Write the named tables of one run below one new directory; one commit makes them visible together.

    Call it after every check has passed: guards run before the first write.  A
    directory that has a commit is an error.
    """
    layout = partition_by or {}
    directory = directory.rstrip("/")
    if not tables:
        raise ValueError("a prediction set needs a table")
    log = CommitLog(next(iter(tables.values())).sparkSession, directory)
    if log.versions():
        raise ValueError(f"{directory} already exists as a published set")
    stored = {}
    for name, table in tables.items():
        stored[name] = write_snapshot(table, f"{directory}/{name}", layout.get(name, ()))
    log.publish({name: {"path": f"{directory}/{name}", "schema": table.schema.jsonValue()} for name, table in stored.items()})
    return stored


def read_prediction_set(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The tables of a published set; a set whose commit is missing was not finished and is an error."""
    from pyspark.sql.types import StructType

    found = CommitLog(spark, directory).read()
    if found is None:
        raise LookupError(f"{directory} is not a published set")
    return {name: spark.read.schema(StructType.fromJson(x["schema"])).parquet(x["path"]) for name, x in found.items()}


def snapshot_manifest(bars: DataFrame, portfolio: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Rows, last date, extreme moves and content per symbol, plus a row for each portfolio series.

    Without a ``series_id`` the portfolio is one row named ``portfolio``, else ``portfolio/<series>``.
    """
    from ..operators.returns import simple_return

    moves = simple_return(bars)
    symbols = moves.groupBy(F.col("ticker").alias("entry")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("date").alias("last_date"),
        F.count_if(F.abs("simple_return") > threshold).alias("extreme_moves_flagged"),
        fingerprint(bars, bars.columns).alias("content"),
    )
    named = F.concat(F.lit("portfolio/"), F.col("series_id")) if "series_id" in portfolio.columns else F.lit("portfolio")
    totals = portfolio.withColumn("entry", named).groupBy("entry").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("date").alias("last_date"),
        F.lit(0).cast("long").alias("extreme_moves_flagged"),
        fingerprint(portfolio, portfolio.columns, RETURN_BITS).alias("content"),
    )
    return symbols.unionByName(totals)
