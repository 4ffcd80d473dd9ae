"""Append-only registry of forecasts made before their target session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite, var_from_quantile
from ..functions.parsing import EXCHANGE_ZONE
from ..session import materialize

KEY = ["model_name", "model_version", "target_date"]
COLUMNS = [
    "forecast_id", "model_name", "model_version", "generated_at", "data_as_of_date", "target_date", "quantile_alpha",
    "quantile_return", "var_return", "training_start", "training_end", "feature_version", "config_hash", "data_hash",
    "git_commit",
]


def _hex(name: str, length: int) -> Column:
    return F.col(name).rlike(f"^[0-9a-fA-F]{{{length}}}$")


def rules() -> dict[str, Column]:
    """Name and condition of every rule a registered row must meet."""
    made_on = F.to_date(F.from_utc_timestamp("generated_at", EXCHANGE_ZONE))
    return {
        "identity": F.trim("forecast_id") != "",
        "labels": (F.trim("model_name") != "") & (F.trim("model_version") != "") & (F.trim("feature_version") != ""),
        "chronology": (F.col("training_start") <= F.col("training_end"))
        & (F.col("training_end") <= F.col("data_as_of_date"))
        & (F.col("data_as_of_date") < F.col("target_date")),
        "made_before_target": (F.col("data_as_of_date") <= made_on) & (made_on < F.col("target_date")),
        "alpha": F.abs(F.col("quantile_alpha") - 0.05) <= 1e-12,
        "quantile": finite(F.col("quantile_return")) & (F.col("quantile_return") >= -1.0),
        "hashes": _hex("config_hash", 64) & _hex("data_hash", 64) & _hex("git_commit", 40),
    }


def first_come(rows: DataFrame) -> DataFrame:
    """The ``_row`` of every row that a registration one by one, by id and key, would accept.

    A row is accepted if no accepted row before it has its key or its id.  All rows
    that are the first of both their groups are accepted together; what shares a key
    or an id with them goes, and the rest is looked at again.  Groups are minima, so
    one key or id may hold any number of rows.
    """
    place = F.struct("forecast_id", *KEY, "_row")
    rest = rows.select("forecast_id", *KEY, "_row")
    accepted = rest.select("_row").limit(0)
    while not rest.isEmpty():
        of_key = rest.groupBy(*KEY).agg(F.min(place).alias("_of_key"))
        of_id = rest.groupBy("forecast_id").agg(F.min(place).alias("_of_id"))
        ahead = materialize(
            rest.join(of_key, KEY).join(of_id, "forecast_id")
            .filter((place == F.col("_of_key")) & (place == F.col("_of_id")))
            .select("forecast_id", *KEY, "_row"),
            "registry-accepted",
        )
        accepted = accepted.unionByName(ahead.select("_row"))
        rest = materialize(
            rest.join(ahead.select(*KEY), KEY, "left_anti").join(ahead.select("forecast_id"), "forecast_id", "left_anti"),
            "registry-rest",
        )
    return accepted


def judge_forecasts(registry: DataFrame | None, new: DataFrame) -> DataFrame:
    """New rows with ``rejected_for``: the first broken rule, a repeated key or id, or NULL when acceptable.

    The batch is written once with row numbers, so of equal rows exactly one is
    accepted.  Rows of stored keys and ids go by one join each, then copies inside
    the batch (:func:`first_come`); a row whose only rival is itself rejected stays.
    """
    reason = F.lit(None).cast("string")
    for name, condition in reversed(list(rules().items())):
        reason = F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    judged = new.withColumns(
        {
            "model_name": F.trim("model_name"),
            "model_version": F.trim("model_version"),
            "feature_version": F.trim("feature_version"),
            "config_hash": F.lower("config_hash"),
            "data_hash": F.lower("data_hash"),
            "git_commit": F.lower("git_commit"),
            "var_return": var_from_quantile(F.col("quantile_return")),
        }
    ).withColumn("_rule", reason)
    judged = materialize(judged.withColumn("_row", F.monotonically_increasing_id()), "judged")
    good = judged.filter(F.col("_rule").isNull())
    if registry is not None:
        good = good.join(registry.select(*KEY).distinct(), KEY, "left_anti")
        good = good.join(registry.select("forecast_id").distinct(), "forecast_id", "left_anti")
    accepted = first_come(good).withColumn("_accepted", F.lit(True))
    return judged.join(accepted, "_row", "left").select(
        *COLUMNS,
        F.coalesce(F.col("_rule"), F.when(F.col("_accepted").isNull(), F.lit("duplicate_key"))).alias("rejected_for"),
    )


def register_forecasts(spark: SparkSession, path: str, new: DataFrame, rejects: str | None = None) -> DataFrame:
    """Append the acceptable rows; rejected ones go to a side table, or raise without one.

    The append of the accepted rows comes last and is the commit: a batch that fails
    before it can be registered again and loses nothing; its rejects are then logged twice.
    """
    try:
        registry = spark.read.parquet(path)
    except Exception as error:  # the first registration finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        registry = None
    judged = materialize(judge_forecasts(registry, new), "judged-batch")
    refused = judged.filter(F.col("rejected_for").isNotNull())
    if rejects is None:
        found = refused.limit(1).collect()
        if found:
            raise ValueError(f"forecast {found[0]['forecast_id']} rejected for {found[0]['rejected_for']}")
    if rejects is not None:
        refused.write.mode("append").parquet(rejects)
    judged.filter(F.col("rejected_for").isNull()).drop("rejected_for").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def with_status(registry: DataFrame) -> DataFrame:
    return registry.withColumn("status", F.lit("PENDING"))


def get_forecast(registry: DataFrame, forecast_id: str, check: bool = True) -> DataFrame:
    """The row of one forecast with its status; an unknown id is an error."""
    row = with_status(registry.filter(F.col("forecast_id") == forecast_id))
    if check and row.isEmpty():
        raise LookupError(f"forecast not found: {forecast_id}")
    return row
