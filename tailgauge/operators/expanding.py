"""Quantiles of all earlier rows, for every row of a long series, in groups of bounded size.

The rows of a series are numbered twice: by session and by value.  Sessions are cut
into chunks of ``block``, values into runs of ``block`` neighbours.  Counts per
(chunk, run), summed along the chunks, say which runs can hold the order statistics
that the sessions of a chunk ask for: a chunk adds at most ``block`` values, so all
of them lie within ``block`` places of the wanted rank.  A chunk's task gets the
earlier values of those few runs, the number of values below them and its own
sessions, and inserts these one by one.
"""

from __future__ import annotations

from bisect import insort
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .blocked import number_rows, number_sessions


def quantiles_of_past(earlier: list[float], below: int, own: list[tuple[int, float]], alpha: float, minimum: int) -> list[float | None]:
    """The quantile of all values before each of ``own`` (position, value), given the relevant earlier ones, sorted."""
    known, out = list(earlier), []
    for position, value in own:
        quantile = None
        if position >= minimum:
            at = alpha * (position - 1)
            low = floor(at)
            a, b = known[low - below], known[min(low + 1, position - 1) - below]
            quantile = a + (at - low) * (b - a)
        out.append(quantile)
        insort(known, value)
    return out


def expanding_quantile(returns: DataFrame, alpha: float = 0.05, minimum: int = 250, block: int = 1024,
                       value: str = "ret", order: str = "date") -> DataFrame:
    """Add ``seen`` (earlier rows) and ``quantile_return`` (their linear quantile) to rows with ``minimum`` earlier ones.

    Rows without a value are left out and count nowhere.  A group of a task holds
    about four times ``block`` values, however long the series is.
    """
    if minimum < 1 or block < 1:
        raise ValueError("minimum and block must be positive")
    numbered = number_sessions(returns.filter(F.col(value).isNotNull()), ("series_id",), order, name="seen")
    ranked = materialize(
        number_rows(numbered, ["series_id"], [value, "seen"], "rank").withColumns(
            {"chunk": F.floor(F.col("seen") / block), "run": F.floor(F.col("rank") / block)}
        ),
        "expanding-ranked",
    )
    cells = ranked.groupBy("series_id", "chunk", "run").agg(F.count(F.lit(1)).alias("n"))
    sizes = ranked.groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), F.max("chunk").alias("last"))
    # every run of a series at every chunk: (rows / block) squared cells, each a sum over earlier chunks
    grid = (
        cells.select("series_id", "run").distinct().join(sizes, "series_id")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        .join(cells, ["series_id", "run", "chunk"], "left")
    )
    along = Window.partitionBy("series_id", "run").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("series_id", "chunk").orderBy("run")
    prefix = grid.withColumn("held", F.coalesce(F.sum("n").over(along), F.lit(0))).withColumn("upto", F.sum("held").over(up))
    first, last = F.col("chunk") * block, F.least((F.col("chunk") + 1) * block, F.col("rows"))
    lowest = F.floor(F.lit(alpha) * (first - 1)) - block
    highest = F.floor(F.lit(alpha) * (last - 1)) + 2
    bands = materialize(
        prefix.withColumns({"lowest": lowest, "highest": highest})
        .filter("held > 0 AND upto > lowest AND upto - held <= highest")
        .select("series_id", "chunk", "run", (F.col("upto") - F.col("held")).alias("below")),
        "expanding-bands",
    )
    below = bands.groupBy("series_id", "chunk").agg(F.min("below").alias("below"))
    earlier = ranked.select("series_id", "run", F.col("chunk").alias("own_chunk"), F.col(value).alias("v")).join(
        bands.select("series_id", "chunk", "run"), ["series_id", "run"]
    ).filter("own_chunk < chunk")
    kept = [c for c in returns.columns]
    nothing = [F.lit(None).cast(returns.schema[c].dataType).alias(c) for c in kept if c != "series_id"]
    members = ranked.select("series_id", "chunk", "seen", F.col(value).alias("_v"), *[c for c in kept if c != "series_id"]).unionByName(
        earlier.select("series_id", "chunk", F.lit(None).cast("long").alias("seen"), F.col("v").alias("_v"), *nothing)
    )
    grouped = members.join(below, ["series_id", "chunk"], "left")

    def run(group: pa.Table) -> pa.Table:
        seen = group.column("seen").to_pylist()
        values = group.column("_v").to_pylist()
        own = sorted((p, v, i) for i, (p, v) in enumerate(zip(seen, values)) if p is not None)
        before = sorted(v for p, v in zip(seen, values) if p is None)
        offset = group.column("below")[0].as_py() or 0
        found = quantiles_of_past(before, offset, [(p, v) for p, v, _ in own], alpha, minimum)
        rows = group.take(pa.array([i for _, _, i in own], pa.int64())).select([*kept, "seen"])
        return rows.append_column("quantile_return", pa.array(found, pa.float64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in returns.schema) + ", seen long, quantile_return double"
    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = grouped.repartition(parts, "series_id", "chunk").groupBy("series_id", "chunk").applyInArrow(run, schema)
    return spread.filter(F.col("quantile_return").isNotNull())
