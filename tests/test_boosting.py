"""Boosted quantile trees: a plain version, both engines, the input contract, sampling, exact selection."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailgauge.models import boosting_kernel as kernel
from tailgauge.models.quantile_boosting import (
    Candidate, QuantileGBT, boost, boosted_predictions, candidate_column, forecast_each, forecast_one, model_rows,
    staged_loss,
)
from tailgauge.models.refits import cv_predictions, refit_tasks, walk_forward_model
from tailgauge.operators.selection import group_quantiles, order_statistics

SCHEMA = "series_id string, target_date date, as_of date, a double, b double, c double, actual_return double"
COLUMNS = ["a", "b", "c"]


def some_rows(n=160, seed=3):
    """a has ties, b has values closer than the gap, c repeats b's order: ties between features."""
    rng = random.Random(seed)
    rows = []
    for name in ("P", "Q"):
        for i in range(n):
            day = date(2020, 1, 1) + timedelta(days=i)
            a, b = rng.randint(0, 9) / 10, rng.random() if i % 5 else 0.5 + i * 1e-9
            y = rng.gauss(0, 1) * (3 if a < 0.4 else 1) if i % 7 else -0.25
            rows.append((name, day, day - timedelta(days=1), a, b, 2 * b, y))
    return rows


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(some_rows(), SCHEMA).repartition(3).cache()


def plain_model(x, y, candidate, alpha, bags=None):
    """Nested lists and loops only; x is rows of single-precision features."""
    ranked = sorted(y)
    at = alpha * (len(y) - 1)
    low = int(at)
    start = ranked[low] + (at - low) * (ranked[min(low + 1, len(y) - 1)] - ranked[low])
    fitted, nodes = [start] * len(y), []
    for stage in range(1, candidate.stages + 1):
        bag = set(range(len(y))) if bags is None else {i for i in range(len(y)) if bags[stage][i]}
        up = [a >= b for a, b in zip(y, fitted)]
        steps = []

        def visit(node, level, own):
            best = None
            inside = [i for i in own if i in bag]
            total = sum(up[i] for i in inside)
            if level < candidate.max_depth and 0 < total < len(inside):
                for f in range(len(x[0])):
                    values = sorted({x[i][f] for i in inside})
                    for lo, hi in zip(values, values[1:]):
                        left = [i for i in inside if x[i][f] <= lo]
                        n1, n2, u1 = len(left), len(inside) - len(left), sum(up[i] for i in left)
                        if hi > lo + 1e-7 and min(n1, n2) >= candidate.min_leaf:
                            gain = float(u1 * len(inside) - total * n1) ** 2 / float(n1 * n2)
                            if best is None or gain > best[0]:
                                best = gain, f, lo if lo / 2 + hi / 2 >= hi else lo / 2 + hi / 2
            if best is None:
                if inside:
                    residuals = sorted(y[i] - fitted[i] for i in inside)
                    steps.append((node, own, residuals[max(1, math.ceil(alpha * len(inside) - 1e-9)) - 1] * candidate.learning_rate))
                return
            nodes.append((stage, node, best[1], best[2]))
            visit(2 * node, level + 1, [i for i in own if x[i][best[1]] <= best[2]])
            visit(2 * node + 1, level + 1, [i for i in own if x[i][best[1]] > best[2]])

        visit(1, 0, list(range(len(y))))
        for node, own, step in steps:
            nodes.append((stage, node, None, step))
            for i in own:
                fitted[i] += step
    return start, sorted(nodes, key=str), fitted


CANDIDATES = [
    Candidate(3, 0.3, 2, 5), Candidate(2, 0.1, 3, 1), Candidate(2, 1.0, 1, 40), Candidate(1, 0.5, 2, 1000),
    Candidate(4, 0.2, 2, 8, subsample=0.5, seed=11),
]


LARGE = [Candidate(2, 0.3, 2, 5), Candidate(2, 0.2, 2, 8, subsample=0.5, seed=11)]


@pytest.mark.parametrize("candidate, limit", [(c, 200_000) for c in CANDIDATES] + [(c, 10) for c in LARGE])
def test_both_engines_grow_the_trees_of_the_plain_version(features, candidate, limit):
    alpha = 0.1
    model = QuantileGBT(COLUMNS, candidate, alpha, limit=limit).fit(features)
    predicted = {(r.series_id, r.target_date): r.quantile_return for r in model.transform(features).collect()}
    for name in ("P", "Q"):
        rows = [r for r in some_rows() if r[0] == name]
        x = [[float(np.float32(v)) for v in r[3:6]] for r in rows]
        bags = None
        if candidate.subsample < 1:
            where = np.arange(len(rows))
            bags = {s: kernel.in_bag(name, where, candidate.seed, s, candidate.subsample) for s in range(1, candidate.stages + 1)}
            assert 0.3 * len(rows) < bags[1].sum() < 0.7 * len(rows) and (bags[1] != bags[2]).any()
        start, nodes, fitted = plain_model(x, [r[6] for r in rows], candidate, alpha, bags)
        assert model.start.filter(F.col("task") == name).first()._init == start
        found = [(r.stage, r._node, r.feature, r.threshold if r.feature is not None else r.value)
                 for r in model.nodes.filter(F.col("task") == name).collect()]
        assert sorted(found, key=str) == nodes
        assert [predicted[name, r[1]] for r in rows] == fitted


def test_held_out_predictions_and_losses_agree_between_engines(features):
    rows = model_rows(features, COLUMNS, keep=["target_date"])
    tasks = refit_tasks(rows, 90, 30, rolling=60).withColumn("task", F.concat_ws("/", "series_id", "refit")).withColumn(
        "config", candidate_column(Candidate(2, 0.2, 2, 4), COLUMNS))
    got = []
    for limit, per_group in ((200_000, 16), (200_000, 1), (10, 16)):
        run = boost(rows, tasks, 0.1, track=True, limit=limit, per_group=per_group)
        got.append((sorted(tuple(r) for r in boosted_predictions(run, "refit").collect()),
                    {(r.task, r.stage): (r.train_loss, r.validation_loss) for r in staged_loss(run).collect()}))
    assert len(got[0][0]) == 2 * 70 and len(got[0][1]) == 2 * 3 * 3
    assert got[0][0] == got[1][0] == got[2][0]
    for key, losses in got[0][1].items():
        assert losses == pytest.approx(got[2][1][key], rel=1e-12) and got[1][1][key] == losses


def test_training_sets_are_not_copied_per_task(features):
    rows = model_rows(features, COLUMNS)
    tasks = refit_tasks(rows, 40, 1).withColumn("task", F.concat_ws("/", "series_id", "refit")).withColumn(
        "config", candidate_column(Candidate(1, 0.2, 1, 4), COLUMNS))
    run = boost(rows, tasks, per_group=60)
    assert run.of("prediction").count() == 2 * 120
    assert rows.count() == 2 * 160  # one row each, whatever the number of models


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), 1e39])
def test_values_must_be_finite(spark, features, bad):
    model = QuantileGBT(COLUMNS, Candidate(1, 0.1, 1, 5)).fit(features)
    broken = features.withColumn("b", F.when(F.col("target_date") == "2020-02-01", F.lit(bad).cast("double")).otherwise(F.col("b")))
    with pytest.raises(ValueError, match="2 rows"):
        QuantileGBT(COLUMNS, Candidate(1, 0.1, 1, 5)).fit(broken)
    with pytest.raises(Exception, match="non-finite feature"):
        model.transform(broken).collect()
    with pytest.raises(ValueError):
        cv_predictions(features.withColumn("actual_return", F.col("b") * F.lit(bad).cast("double")), {"m": Candidate(1)}, COLUMNS)


def test_unknown_series_and_empty_training_sets_raise(spark, features):
    model = QuantileGBT(COLUMNS, Candidate(1, 0.1, 1, 5)).fit(features.filter("series_id = 'P'"))
    with pytest.raises(Exception, match="no model of Q"):
        model.transform(features).collect()
    with pytest.raises(ValueError):
        QuantileGBT(COLUMNS, Candidate(1)).fit(features.limit(0))
    rows = model_rows(features, COLUMNS)
    config = candidate_column(Candidate(1), COLUMNS)
    for series, lo, hi in (("Z", 0, 10), ("P", 500, 600), ("P", 7, 7)):
        tasks = spark.createDataFrame([("t", series, lo, hi, 10, 20)], "task string, series_id string, lo long, hi long, start long, stop long")
        with pytest.raises(ValueError, match="without training rows"):
            boost(rows, tasks.withColumn("config", config))
    assert walk_forward_model(features, Candidate(1), COLUMNS, first=500, refit_every=1).count() == 0


@pytest.mark.parametrize("wrong", [
    {"stages": 0}, {"stages": 2.5}, {"stages": True}, {"max_depth": -1}, {"min_leaf": 0}, {"learning_rate": 0.0},
    {"learning_rate": math.inf}, {"subsample": 1.2}, {"subsample": 0}, {"seed": 1.5}, {"features": ()}, {"features": ("a", "a")},
])
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        Candidate(**wrong)


@pytest.mark.parametrize("alpha", [0, 1, -0.1, math.nan, True, "x"])
def test_alpha_is_checked(alpha):
    with pytest.raises(ValueError):
        QuantileGBT(COLUMNS, alpha=alpha)


def test_one_forecast_and_one_each(features):
    model = QuantileGBT(COLUMNS, Candidate(2, 0.1, 2, 5)).fit(features)
    newest = features.filter(F.col("target_date") == features.agg(F.max("target_date")).first()[0])
    assert forecast_each(model, newest).count() == 2
    with pytest.raises(ValueError):
        forecast_each(model, features)
    with pytest.raises(ValueError):
        forecast_one(model, newest)


@pytest.mark.parametrize("bins, small", [(1024, 4096), (4, 3)])
def test_selection_equals_sorting(spark, bins, small):
    rng = random.Random(1)
    groups = {
        "a": [rng.gauss(0, 1) for _ in range(500)], "b": [1.5] * 400 + [rng.random() for _ in range(30)], "c": [2.0],
        "d": [rng.choice([0.0, -1e9, 1e-9, 5.0]) for _ in range(200)],
    }
    df = spark.createDataFrame([(k, v) for k, x in groups.items() for v in x], "k string, v double").repartition(4)
    asked = [(k, r) for k, x in groups.items() for r in {1, len(x), len(x) // 2 or 1, len(x) // 20 or 1, len(x) + 1, 0}]
    ranks = spark.createDataFrame(asked, "k string, rank long")
    for r in order_statistics(df, ranks, ["k"], "v", bins, small).collect():
        want = sorted(groups[r.k])[r["rank"] - 1] if 1 <= r["rank"] <= len(groups[r.k]) else None
        assert r.selected == want
    for alpha in (0.05, 1.0):
        for r in group_quantiles(df, ["k"], "v", alpha, bins, small).collect():
            assert r.quantile == kernel.linear_quantile(np.array(groups[r.k]), alpha)
