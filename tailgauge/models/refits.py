"""Boosted models on folds, holdouts, grids and refit points.

Each function lays out its models as ranges of positions in the series; rows are
written once and all models of a call are trained together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantile_boosting import (
    Boosted,
    Candidate,
    boost,
    boosted_predictions,
    model_rows,
    staged_loss,
    with_candidates,
)

KEYS = ["target_date", "as_of"]


def _train(rows: DataFrame, tasks: DataFrame, key: str, grid: Mapping[str, Candidate], columns: Sequence[str],
           track: bool = False) -> Boosted:
    named = tasks.withColumn("task", F.concat_ws("/", "series_id", key))
    return boost(rows, with_candidates(named, grid, list(columns)), track=track, trees=False)


def _named(run: Boosted, key: str) -> DataFrame:
    """Predictions with the candidate name as ``model``."""
    return boosted_predictions(run, key, "candidate").select(
        "series_id", F.col("candidate").alias("model"), F.col(key).cast("string").alias(key), "as_of", "target_date",
        "actual_return", "quantile_return", "var", "violation",
    )


def fold_tasks(rows: DataFrame, k: int = 5) -> DataFrame:
    """Fold f trains on all blocks before block f and predicts block f; see :func:`folds.expanding_folds`."""
    if k < 2:
        raise ValueError("k must be at least 2")
    width = F.floor(F.col("n") / F.lit(k + 1))
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("width", width).filter("width > 0")
    opens = F.col("n") - (F.lit(k + 1) - F.col("fold")) * F.col("width")
    return sizes.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).select(
        "series_id", "fold", F.lit(0).cast("long").alias("lo"), opens.alias("hi"), opens.alias("start"),
        (opens + F.col("width")).alias("stop"),
    )


def cv_predictions(features: DataFrame, grid: Mapping[str, Candidate], columns: Sequence[str], k: int = 5) -> DataFrame:
    """Every candidate refit once per expanding fold; predictions of the validation blocks."""
    rows = model_rows(features, columns, keep=KEYS)
    return _named(_train(rows, fold_tasks(rows, k), "fold", grid, columns), "fold")


def cv_staged_loss(features: DataFrame, candidate: Candidate, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Training and validation loss per fold after every boosting stage."""
    rows = model_rows(features, columns)
    run = _train(rows, fold_tasks(rows, k), "fold", {"model": candidate}, columns, track=True)
    return staged_loss(run, "series_id", "fold").select("series_id", "fold", "stage", "train_loss", "validation_loss")


def holdout_predictions(features: DataFrame, grid: Mapping[str, Candidate], columns: Sequence[str],
                        development_end: date) -> DataFrame:
    """One fit on the development rows, predictions of the holdout rows."""
    rows = model_rows(features, columns, keep=KEYS)
    early = F.count_if(F.col("target_date") <= F.lit(development_end))
    tasks = rows.groupBy("series_id").agg(early.alias("hi"), F.count("*").alias("stop")).select(
        "series_id", F.lit("holdout").alias("part"), F.lit(0).cast("long").alias("lo"), "hi", F.col("hi").alias("start"), "stop"
    )
    return _named(_train(rows, tasks, "part", grid, columns), "part")


def refit_tasks(rows: DataFrame, first: int, refit_every: int, rolling: int | None = None) -> DataFrame:
    """Refit k trains before position first + k * refit_every and predicts up to the next refit."""
    if first < 1 or refit_every < 1 or (rolling is not None and rolling < 1):
        raise ValueError("first, refit_every and rolling must be positive")
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n")).filter(F.col("n") > first)
    last = F.floor((F.col("n") - 1 - first) / refit_every)
    opens = F.lit(first) + F.col("refit") * refit_every
    lo = F.lit(0) if rolling is None else F.greatest(F.lit(0), opens - rolling)
    return sizes.withColumn("refit", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "series_id", "refit", lo.cast("long").alias("lo"), opens.alias("hi"), opens.alias("start"),
        F.least(opens + refit_every, "n").alias("stop"),
    )


def walk_forward_model(features: DataFrame, candidate: Candidate, columns: Sequence[str], first: int,
                       refit_every: int, rolling: int | None = None) -> DataFrame:
    """Refit every ``refit_every`` sessions on all earlier (or the last ``rolling``) rows.

    Refit k predicts sessions first + k * refit_every up to the next refit, for as
    many refits as a series has sessions.  ``refit_every`` 1 is one model per target.
    """
    rows = model_rows(features, columns, keep=KEYS)
    return _named(_train(rows, refit_tasks(rows, first, refit_every, rolling), "refit", {"model": candidate}, columns), "refit")


def paired_gain(predictions: DataFrame, base: str, candidate: str) -> DataFrame:
    """Loss of two candidates per fold and the gain of the second."""
    from ..functions import pinball

    loss = pinball(F.col("actual_return"), F.col("quantile_return"))

    def of(model: str):
        return F.avg(F.when(F.col("model") == model, loss))

    return predictions.groupBy("series_id", "fold").agg(
        F.count_if(F.col("model") == base).alias("n_targets"),
        of(base).alias("base_loss"),
        of(candidate).alias("candidate_loss"),
        (of(base) - of(candidate)).alias("gain"),
    )
