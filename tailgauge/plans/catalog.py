"""Registry of the runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .fixtures import Tables, with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round double columns so that two engines' last bits do not show."""
    columns = [
        # adding zero turns a negative zero into zero
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return df.select(*columns)


def query(name: str, tables: str = "", sql: str | None = None, doubles: str = "", digits: int = 8):
    """Register a function of Tables; ``sql`` is the same result over the tables named in ``tables``."""

    def register(function: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return rounded(function(Tables(spark, path)), digits)

        QUERIES[name] = run
        if sql is not None:
            inner = sql.strip()
            if doubles:
                fixed = ", ".join(f'round("{c}", {digits}) + 0 AS "{c}"' for c in doubles.split())
                inner = f"SELECT * REPLACE ({fixed}) FROM ({inner})"
            elif inner.startswith("WITH"):
                inner = f"SELECT * FROM ({inner})"
            SQL[name] = with_tables(tuple(tables.split()), inner)
        return function

    return register
