"""Catalog: boosted quantile models, with SQL that grows the same trees stage by stage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions.parsing import next_open_session
from ..models import refits as B
from ..models.folds import cv_ranking
from ..models.forecast import next_session_forecast
from ..models.quantile_boosting import Candidate, QuantileGBT, forecast_each
from ..operators.features import FEATURES_7, FEATURES_12, feature_table_7f
from ..operators.metrics import fold_metrics
from .boosting_sql import FINAL, TASKS, boosted, development_tasks, holdout_tasks, predictions, refit_tasks
from .catalog import query
from .fixtures import CTES, SPLIT, Tables
from .models_queries import NEXT

# The frozen candidates.
G04 = Candidate(stages=100, learning_rate=0.03, max_depth=2, min_leaf=5, features=tuple(FEATURES_7))
C1 = Candidate(stages=150, learning_rate=0.03, max_depth=2, min_leaf=10)
# What SQL grows for comparison in the large layouts is shorter; the engines do not depend on the number of stages.
SHORT = 20
BASE = Candidate(stages=SHORT, learning_rate=0.1, max_depth=2, min_leaf=5)
GRID = {
    "depth2": BASE,
    "depth1": Candidate(stages=SHORT, learning_rate=0.1, max_depth=1, min_leaf=5),
    "depth3": Candidate(stages=SHORT, learning_rate=0.1, max_depth=3, min_leaf=5),
    "slow": Candidate(stages=SHORT, learning_rate=0.05, max_depth=2, min_leaf=10),
}
ABLATION = {
    "seven": Candidate(SHORT, 0.1, 2, 5, tuple(FEATURES_7)),
    "twelve": Candidate(SHORT, 0.1, 2, 5, tuple(FEATURES_12)),
}
LOSS = "greatest(0.05 * (actual_return - quantile_return), -0.95 * (actual_return - quantile_return))"
OUTCOME = "actual_return quantile_return var"


@query("quantile_gbt", "feat12", boosted(
    development_tasks(SPLIT), {"m": C1}, FEATURES_12,
    f"SELECT series_id, target_date, y AS actual_return, p AS quantile_return, greatest(0e0, -p) AS var FROM {FINAL}",
), OUTCOME)
def _(t: Tables):
    """Fit on the development rows of every portfolio, predict all rows with the written trees."""
    rows = t.features
    model = QuantileGBT(FEATURES_12, C1).fit(rows.filter(F.col("target_date") <= F.lit(date.fromisoformat(SPLIT))))
    return model.transform(rows).select("series_id", "target_date", "actual_return", "quantile_return", "var")


@query("forecast_one", "feat12", boosted(
    TASKS["whole"], {"m": C1}, FEATURES_12,
    f"""SELECT series_id, p AS quantile_return, greatest(0e0, -p) AS var FROM {FINAL}
    QUALIFY target_date = max(target_date) OVER (PARTITION BY series_id)""",
), "quantile_return var")
def _(t: Tables):
    """The newest row of every series."""
    rows = t.features
    model = QuantileGBT(FEATURES_12, C1).fit(rows)
    newest = rows.join(rows.groupBy("series_id").agg(F.max("target_date").alias("target_date")), ["series_id", "target_date"])
    return forecast_each(model, newest)


@query("walk_forward_model", "feat12", boosted(refit_tasks(250, 125), {"model": BASE}, FEATURES_12, predictions("refit")), OUTCOME)
def _(t: Tables):
    return B.walk_forward_model(t.features, BASE, FEATURES_12, first=250, refit_every=125)


@query("walk_forward_model_rolling", "feat12", boosted(refit_tasks(250, 250, 250), {"model": G04}, FEATURES_7, predictions("refit")), OUTCOME)
def _(t: Tables):
    return B.walk_forward_model(t.features, G04, FEATURES_7, first=250, refit_every=250, rolling=250)


@query("cv_predictions", "feat12 foldpred", f"""SELECT * FROM ({boosted(TASKS['folds'], {'boosted': G04}, FEATURES_12, predictions('fold'))})
  UNION ALL BY NAME SELECT series_id, model, fold, as_of, target_date, actual_return, quantile_return, var, violation FROM foldpred""", OUTCOME)
def _(t: Tables):
    return B.cv_predictions(t.features, {"boosted": G04}, FEATURES_12).unionByName(t.fold_predictions)


@query("holdout_predictions", "feat12", boosted(holdout_tasks(SPLIT), {"boosted": C1}, FEATURES_12, predictions("part")), OUTCOME)
def _(t: Tables):
    return B.holdout_predictions(t.features, {"boosted": C1}, FEATURES_12, date.fromisoformat(SPLIT))


@query("model_grid", "feat12", f"""
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY cv_mean_loss, model) AS rank FROM (
    SELECT series_id, model, avg(loss) AS cv_mean_loss, count(*) AS folds FROM (
      SELECT series_id, model, fold, avg({LOSS}) AS loss
      FROM ({boosted(TASKS['folds'], GRID, FEATURES_12, predictions('fold'))}) GROUP BY 1, 2, 3) GROUP BY 1, 2)
""", "cv_mean_loss")
def _(t: Tables):
    """All candidates of the grid on all folds in one call, one ranked row per series and candidate."""
    found = B.cv_predictions(t.features, GRID, FEATURES_12)
    return cv_ranking(fold_metrics(found).filter(F.col("fold") != "all_validation"))


@query("feature_ablation", "feat12", f"""
  SELECT series_id, fold, count(*) FILTER (model = 'seven') AS n_targets, avg({LOSS}) FILTER (model = 'seven') AS base_loss,
    avg({LOSS}) FILTER (model = 'twelve') AS candidate_loss,
    avg({LOSS}) FILTER (model = 'seven') - avg({LOSS}) FILTER (model = 'twelve') AS gain
  FROM ({boosted(TASKS['folds'], ABLATION, FEATURES_12, predictions('fold'))}) GROUP BY 1, 2
""", "base_loss candidate_loss gain")
def _(t: Tables):
    return B.paired_gain(B.cv_predictions(t.features, ABLATION, FEATURES_12), "seven", "twelve")


@query("staged_loss", "feat12", boosted(TASKS["folds"], {"model": G04}, FEATURES_12, """
  SELECT series_id, CAST(part AS INTEGER) AS fold, stage, avg(loss) FILTER (tr) AS train_loss,
    avg(loss) FILTER (held) AS validation_loss
  FROM (SELECT *, greatest(0.05 * (y - p), -0.95 * (y - p)) AS loss FROM state JOIN base USING (r)) GROUP BY 1, 2, 3
"""), "train_loss validation_loss")
def _(t: Tables):
    return B.cv_staged_loss(t.features, G04, FEATURES_12)


# the returns with the next session, whose weekday has to be one on which the series was open before
CTES["portp"] = (("port",), """
  SELECT series_id, date, ret FROM port UNION ALL
  SELECT series_id, date, 0e0 FROM (
    SELECT series_id, last + CAST(k AS INTEGER) AS date, row_number() OVER (PARTITION BY series_id ORDER BY k) AS nth
    FROM (SELECT series_id, max(date) AS last, list(DISTINCT isodow(date)) AS days FROM port GROUP BY 1), range(1, 32) AS t(k)
    WHERE list_contains(days, isodow(last + CAST(k AS INTEGER)))) WHERE nth = 1""")
CTES["featp"] = (("portp",), CTES["feat"][1].replace("FROM port)", "FROM portp)"))
CTES["featnext"] = (("featp",), """
  SELECT series_id, date AS target_date, as_of, ret AS actual_return, * EXCLUDE (series_id, date, as_of, ret)
  FROM featp WHERE rolling_vol_60 IS NOT NULL""")


@query("next_session_forecast_boosted", "ewma featnext", f"""{NEXT}
  UNION ALL SELECT series_id, 'gradient_boosting', as_of, quantile_return, var FROM (
    {boosted(TASKS['whole'], {'m': G04}, FEATURES_7,
             f"SELECT series_id, as_of, p AS quantile_return, greatest(0e0, -p) AS var FROM {FINAL} AND coming",
             features="featnext", asked="(series_id, target_date) NOT IN (SELECT (series_id, date) FROM port)")})
""", "quantile_return var")
def _(t: Tables):
    """All three models for the session after the last observation.

    The feature row of that session comes from appending one session without a
    return to every series; the day is the next on which the series is open.
    """
    following = t.portfolio.groupBy("series_id").agg(
        F.max("date").alias("as_of"), F.collect_set(F.weekday("date")).alias("open")
    ).select("series_id", next_open_session(F.col("as_of"), F.col("open")).alias("date"), "as_of")
    padded = t.portfolio.unionByName(
        following.select("series_id", "date", F.lit(0.0).alias("ret"))
    )
    newest = feature_table_7f(padded).join(
        following.select("series_id", F.col("date").alias("target_date"), "as_of"), ["series_id", "target_date"]
    )
    model = QuantileGBT(FEATURES_7, G04).fit(t.features)
    found = model.transform(newest).withColumn("method", F.lit("gradient_boosting"))
    return next_session_forecast(t.portfolio, extra=found)
