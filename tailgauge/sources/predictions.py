"""Prediction tables kept as text files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse_flag

# Columns and types of a prediction file.
PREDICTION_FILE: Mapping[str, str] = {
    "series_id": "string", "method": "string", "as_of": "date", "target_date": "date", "actual_return": "double",
    "quantile_return": "double", "var": "double", "violation": "string",
}


def read_predictions(spark: SparkSession, path: str | Sequence[str], check: bool = True) -> DataFrame:
    """Typed prediction rows; a violation that is neither true nor false is an error."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in PREDICTION_FILE])
    text = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    rows = text.select(
        *[
            parse_flag(F.col(n)).alias(n) if n == "violation" else F.col(n).try_cast(t).alias(n)
            for n, t in PREDICTION_FILE.items()
        ]
    )
    if check:
        unreadable = F.lit(False)
        for name in PREDICTION_FILE:
            unreadable = unreadable | F.col(name).isNull()
        if not rows.filter(unreadable).isEmpty():
            raise ValueError("prediction file holds unreadable values")
    return rows
