"""Quantile gradient boosting of many models at once.

A *task* is one model: a fold, a refit point, a candidate of a grid, a portfolio.
Its training set is a range of positions in one series, and so are the rows it
predicts.  The rows of a series are therefore kept once, however many overlapping
training sets refer to them; nothing is copied per task.

The rules of a model: start at the alpha-quantile of the training labels; at each
stage grow a tree on the sign of the residuals (alpha above, alpha - 1 below) by
exact search over all midpoints of neighbouring feature values, which are single
precision; a node is split if it is not pure, both sides hold ``min_leaf`` rows and
the weighted squared difference of the side means is largest (ties: first feature,
lowest threshold); a leaf adds the alpha-quantile of its residuals (the least one
that covers alpha of them) times the learning rate.  With ``subsample`` below 1 a
hash of task, stage and row decides which rows a stage learns from, the same after
a retry.

Tasks of up to ``limit`` rows are grown whole, many at a time in each Spark task,
on ranges of their series; larger ones grow in the distributed loop of
:mod:`boosting_loop`.  Both follow the same rules and give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import var_from_quantile
from ..operators.blocked import number_sessions
from ..session import materialize
from .boosting_kernel import grow
from .boosting_loop import LargeModels

ROW_LIMIT = 200_000
GROWN = "task string, kind string, stage int, node int, feature int, position long, value double, more double"


@dataclass(frozen=True)
class Candidate:
    """Hyper-parameters of one model; ``features`` None means all columns."""

    stages: int = 100
    learning_rate: float = 0.05
    max_depth: int = 2
    min_leaf: int = 5
    features: tuple[str, ...] | None = None
    subsample: float = 1.0
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("stages", "max_depth", "min_leaf"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive whole number")
        for name in ("learning_rate", "subsample"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
                raise ValueError(f"{name} must be a positive finite number")
        if self.subsample > 1:
            raise ValueError("subsample must not exceed 1")
        if isinstance(self.seed, bool) or not isinstance(self.seed, int):
            raise ValueError("seed must be a whole number")
        if self.features is not None and (not self.features or len(set(self.features)) < len(self.features)):
            raise ValueError("features must be distinct names")


def require_alpha(alpha: float) -> float:
    if isinstance(alpha, bool) or not isinstance(alpha, (int, float)) or not 0 < alpha < 1:
        raise ValueError("alpha must be a number between 0 and 1")
    return float(alpha)


def candidate_column(candidate: Candidate, columns: Sequence[str]) -> Column:
    """The candidate as a struct literal, feature names turned into positions."""
    chosen = list(columns) if candidate.features is None else list(candidate.features)
    unknown = [c for c in chosen if c not in columns]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    return F.struct(
        F.lit(candidate.stages).alias("stages"),
        F.lit(float(candidate.learning_rate)).alias("learning_rate"),
        F.lit(candidate.max_depth).alias("max_depth"),
        F.lit(candidate.min_leaf).alias("min_leaf"),
        F.lit(float(candidate.subsample)).alias("subsample"),
        F.lit(candidate.seed).cast("long").alias("seed"),
        F.array(*[F.lit(columns.index(c)) for c in chosen]).alias("used"),
    )


def with_candidates(tasks: DataFrame, grid: Mapping[str, Candidate], columns: Sequence[str]) -> DataFrame:
    """Repeat the tasks for every candidate of a grid and name them after both; rows are not repeated."""
    options = F.array(
        *[F.struct(F.lit(n).alias("candidate"), candidate_column(c, columns).alias("config")) for n, c in grid.items()]
    )
    return tasks.select("*", F.inline(options)).withColumn("task", F.concat_ws("/", "task", "candidate"))


def feature_vector(columns: Sequence[str]) -> Column:
    """The features in single precision."""
    return F.array(*[F.col(f"`{c}`").cast("float") for c in columns])


def not_finite(value: Column) -> Column:
    """NULL, NaN or infinite, after rounding to single precision."""
    single = value.cast("float")
    return single.isNull() | F.isnan(single) | (F.abs(single) == F.lit(float("inf")))


def model_rows(features: DataFrame, columns: Sequence[str], label: str = "actual_return", series: str = "series_id",
               order: str = "target_date", keep: Sequence[str] = ()) -> DataFrame:
    """series_id, position, label, x and the kept columns, written once; raises on values that are not finite."""
    if not columns or len(set(columns)) < len(columns):
        raise ValueError("feature columns must be distinct and not empty")
    numbered = number_sessions(
        features.withColumnRenamed(series, "series_id") if series != "series_id" else features, ("series_id",), order
    )
    wrong = [not_finite(F.col(f"`{c}`")).cast("int") for c in (*columns, label)]
    rows = materialize(
        numbered.select(
            "series_id", "position", F.col(label).cast("double").alias("label"), feature_vector(columns).alias("x"), *keep,
            sum(wrong[1:], wrong[0]).alias("faults"),
        ),
        "model-rows",
    )
    found = rows.agg(F.count_if(F.expr("faults > 0")).alias("n"), F.count_if(F.expr("series_id IS NULL")).alias("nameless")).first()
    if found.n or found.nameless:
        raise ValueError(f"{found.n} rows with missing or non-finite features or labels, {found.nameless} without a series")
    return rows.drop("faults")


@dataclass
class Boosted:
    """What training gives: ``grown`` holds start values, nodes, losses and predictions by ``kind``."""

    spark: SparkSession
    rows: DataFrame
    tasks: DataFrame
    grown: DataFrame

    def of(self, kind: str) -> DataFrame:
        return self.grown.filter(F.col("kind") == kind)


def _small(rows: DataFrame, tasks: DataFrame, alpha: float, track: bool, trees: bool, per_group: int) -> DataFrame:
    """Grow tasks in groups: ``per_group`` tasks that follow each other in a series share one copy of their range."""
    along = Window.partitionBy("series_id").orderBy("hi", "task")
    grouped = materialize(
        tasks.withColumn("chunk", F.floor((F.row_number().over(along) - 1) / per_group)), "boosting-tasks"
    )
    ranges = materialize(
        grouped.groupBy("series_id", "chunk").agg(
            F.least(F.min("lo"), F.min("start")).alias("first"), F.greatest(F.max("hi"), F.max("stop")).alias("last")
        ),
        "boosting-ranges",
    )
    dealt = rows.select("series_id", "position", "label", "x").join(ranges, "series_id").filter("position >= first AND position < last")
    # groups cost far more than their bytes: as many partitions as there are groups, within reason
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4096, ranges.count()))
    left = dealt.drop("first", "last").repartition(parts, "series_id", "chunk").groupBy("series_id", "chunk")
    right = grouped.repartition(parts, "series_id", "chunk").groupBy("series_id", "chunk")

    def run(data: pa.Table, models: pa.Table) -> pa.Table:
        data = data.sort_by("position")
        positions = data.column("position").to_numpy().astype(np.int64)
        y = data.column("label").to_numpy()
        flat = data.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = np.ascontiguousarray(flat.reshape(len(positions), -1).T.astype(np.float64))
        order = np.argsort(x, axis=1, kind="stable")
        out: dict[str, list] = {c.split()[0]: [] for c in GROWN.split(", ")}

        def emit(task: str, kind: str, **values) -> None:
            n = len(next(iter(values.values())))
            for name in out:
                out[name].append({"task": [task] * n, "kind": [kind] * n}.get(name, values.get(name, [None] * n)))

        def span(low: int, high: int) -> slice:
            return slice(*np.searchsorted(positions, [low, high]).tolist())

        for model in models.to_pylist():
            config = model["config"]
            held = span(model["start"], model["stop"])
            grown = grow(
                x, order, y, positions, span(model["lo"], model["hi"]), held, model["task"], config["stages"],
                config["learning_rate"], config["max_depth"], config["min_leaf"], config["subsample"], config["seed"],
                config["used"], alpha, track,
            )
            emit(model["task"], "prediction", position=positions[held].tolist(), value=grown.predicted.tolist())
            if trees:
                emit(model["task"], "start", value=[grown.start])
                stage, node, feature, value = zip(*grown.nodes)
                emit(model["task"], "node", stage=stage, node=node, feature=feature, value=value)
            if track:
                stage, loss, later = zip(*grown.losses)
                emit(model["task"], "loss", stage=stage, value=loss, more=[None if math.isnan(z) else z for z in later])
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        return pa.table(
            {c.split()[0]: pa.array([z for part in out[c.split()[0]] for z in part], kinds[c.split()[1]]) for c in GROWN.split(", ")}
        )

    return left.cogroup(right).applyInArrow(run, GROWN)


def boost(rows: DataFrame, tasks: DataFrame, alpha: float = 0.05, track: bool = False, trees: bool = True,
          limit: int = ROW_LIMIT, per_group: int = 16) -> Boosted:
    """Train every task.

    ``rows`` comes from :func:`model_rows`; ``tasks`` holds task, series_id, the
    training positions lo <= p < hi, the positions to predict start <= p < stop, and
    config.  A task whose series is unknown or whose training set is empty is an
    error.  An empty table of tasks gives empty results.
    """
    require_alpha(alpha)
    spark = rows.sparkSession
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("rows"))
    trained = F.greatest(F.lit(0), F.least("hi", "rows") - F.greatest("lo", F.lit(0)))
    tasks = materialize(
        tasks.join(sizes, "series_id", "left").withColumn("trained", F.when(F.col("rows").isNull(), 0).otherwise(trained)).withColumn(
            "large", F.greatest("hi", F.least("stop", "rows")) - F.least("lo", "start") > limit
        ),
        "boosting-tasks",
    )
    state = tasks.agg(
        F.count_if(F.expr("trained = 0")).alias("empty"), F.count("*").alias("n"), F.count_distinct("task").alias("names"),
        F.count_if(F.expr("large")).alias("large"), F.count_if(F.expr("NOT large")).alias("small"),
        F.max("config.stages").alias("stages"), F.max("config.max_depth").alias("depth"),
    ).first()
    if state.empty:
        raise ValueError(f"{state.empty} models without training rows or of an unknown series")
    if state.names < state.n:
        raise ValueError("task names repeat")
    parts = []
    if state.small or not state.large:
        parts.append(_small(rows, tasks.filter("NOT large"), alpha, track, trees, per_group))
    if state.large:
        large = LargeModels(rows, tasks.filter("large").drop("rows", "trained", "large"), alpha, track)
        for stage in range(1, state.stages + 1):
            large.grow(stage, state.depth)
        parts.append(large.results())
    grown = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Boosted(spark, rows, tasks, materialize(grown, "boosting-grown"))


def boosted_predictions(run: Boosted, *keys: str) -> DataFrame:
    """Predictions of every task's rows with VaR and violation; ``keys`` are columns of the tasks to keep."""
    predicted = run.of("prediction").select("task", "position", F.col("value").alias("quantile_return"))
    return (
        predicted.join(run.tasks.select("task", "series_id", *keys), "task")
        .join(run.rows.drop("x").withColumnRenamed("label", "actual_return"), ["series_id", "position"])
        .withColumn("var", var_from_quantile(F.col("quantile_return")))
        .withColumn("violation", F.col("actual_return") < F.col("quantile_return"))
        .drop("position")
    )


def staged_loss(run: Boosted, *keys: str) -> DataFrame:
    """Mean training and validation loss of each task after every stage (0 is the start value)."""
    losses = run.of("loss").select(
        "task", "stage", F.col("value").alias("train_loss"), F.col("more").alias("validation_loss")
    )
    return losses.join(run.tasks.select("task", *keys), "task") if keys else losses


class QuantileGBT(Estimator):
    """Estimator of one quantile model per value of ``task`` in the training data."""

    def __init__(self, columns: Sequence[str], candidate: Candidate = Candidate(), alpha: float = 0.05,
                 label: str = "actual_return", task: str = "series_id", order: str = "target_date", limit: int = ROW_LIMIT) -> None:
        super().__init__()
        self.columns = list(columns)
        self.candidate = candidate
        self.alpha = require_alpha(alpha)
        self.label = label
        self.task = task
        self.order = order
        self.limit = limit

    def _fit(self, dataset: DataFrame) -> QuantileGBTModel:
        rows = model_rows(dataset, self.columns, self.label, self.task, self.order)
        whole = rows.groupBy("series_id").agg(F.count("*").alias("hi"))
        nothing = F.lit(0).cast("long")
        tasks = whole.select(
            F.col("series_id").cast("string").alias("task"), "series_id", nothing.alias("lo"), "hi", nothing.alias("start"),
            nothing.alias("stop"), candidate_column(self.candidate, self.columns).alias("config"),
        )
        run = boost(rows, tasks, self.alpha, limit=self.limit)
        if run.tasks.isEmpty():
            raise ValueError("the training set is empty")
        return QuantileGBTModel(self, run)


class QuantileGBTModel(Model):
    """Trees of every task as tables; prediction folds over them inside one projection."""

    def __init__(self, estimator: QuantileGBT, run: Boosted) -> None:
        super().__init__()
        self.estimator = estimator
        self.start = run.of("start").select("task", F.col("value").alias("_init"))
        leaf = F.col("feature").isNull()
        self.nodes = run.of("node").select(
            "task", "stage", F.col("node").alias("_node"), "feature",
            F.when(~leaf, F.col("value")).alias("threshold"), F.when(leaf, F.col("value")).alias("value"),
        )

    def trees(self) -> DataFrame:
        """One row per task: start value and its trees in the order of stages, each an array of entries by node."""
        entry = F.struct(F.col("_node"), F.struct("feature", "threshold", "value"))
        per_tree = self.nodes.groupBy("task", "stage").agg(F.map_from_entries(F.collect_list(entry)).alias("_by"))
        places = F.sequence(F.lit(0), F.lit(2 ** (self.estimator.candidate.max_depth + 1) - 1))
        tree = F.transform(places, lambda i: F.try_element_at(F.col("_by"), i))
        by_stage = F.map_from_entries(F.collect_list(F.struct("stage", tree.alias("_tree"))))
        stages = F.sequence(F.lit(1), F.lit(self.estimator.candidate.stages))
        per_task = per_tree.groupBy("task").agg(by_stage.alias("_by")).select(
            "task", F.transform(stages, lambda i: F.try_element_at(F.col("_by"), i)).alias("_trees")
        )
        return self.start.join(per_task, "task", "left")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows of tasks without a model and rows with missing or non-finite features are errors."""
        columns = self.estimator.columns
        levels = F.sequence(F.lit(1), F.lit(self.estimator.candidate.max_depth))

        def value(tree: Column) -> Column:
            def down(node: Column, _: Column) -> Column:
                here = F.get(tree, node)
                right = F.get(F.col("_x"), here["feature"]).cast("double") > here["threshold"]
                return F.when(here["feature"].isNotNull(), node * 2 + right.cast("int")).otherwise(node)

            return F.get(tree, F.aggregate(levels, F.lit(1), down))["value"]

        # stages are added in their order, so the sum is the same on every run
        total = F.aggregate(
            F.col("_trees"), F.col("_init"), lambda acc, tree: acc + F.coalesce(value(tree), F.lit(0.0))
        )
        name = self.estimator.task
        faulty = not_finite(F.col(f"`{columns[0]}`"))
        for c in columns[1:]:
            faulty = faulty | not_finite(F.col(f"`{c}`"))
        checked = (
            F.when(F.col("_init").isNull(), F.raise_error(F.concat(F.lit("no model of "), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("NULL")))))
            .when(faulty, F.raise_error(F.lit("missing or non-finite feature")))
            .otherwise(total)
        )
        trees = self.trees().withColumnRenamed("task", "_task")
        return (
            dataset.withColumn("_x", feature_vector(columns))
            .join(trees, F.col(f"`{name}`").cast("string") == F.col("_task"), "left")
            .withColumn("quantile_return", checked.cast("double"))
            .withColumn("var", var_from_quantile(F.col("quantile_return")))
            .drop("_trees", "_init", "_task", "_x")
        )


def forecast_one(model: QuantileGBTModel, row: DataFrame) -> DataFrame:
    """Quantile and VaR of exactly one feature row."""
    if row.limit(2).count() != 1:
        raise ValueError("exactly one feature row is required")
    return model.transform(row).select("quantile_return", "var")


def forecast_each(model: QuantileGBTModel, rows: DataFrame) -> DataFrame:
    """Quantile and VaR of exactly one feature row of every task."""
    name = model.estimator.task
    again = rows.groupBy(name).count().filter("count > 1")
    if not again.isEmpty():
        raise ValueError("exactly one feature row of each task is required")
    return model.transform(rows).select(name, "quantile_return", "var")
