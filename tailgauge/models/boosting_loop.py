"""Growing the trees of models that are too large for one task.

All such models grow together.  A stage reads its state (rows with features and
prediction) in the partitions in which it was written and writes the next one in
the same partitions: rows never move after the start.  What crosses the network
are counts:

* **Split search.**  Each feature's values are cut into blocks at approximate
  quantiles, once.  Counts per (task, node, feature, block) give the exact gain of
  every split between blocks, and a bound of the gains inside a block (the gain is
  convex in the counts, so the bound is taken at the corners of what the block's
  counts allow).  Only blocks whose bound reaches the best known gain are counted
  value by value.  The result is the exact best split, whatever the blocks.
* **Leaves.**  The quantile of each leaf's residuals by exact selection
  (:mod:`..operators.selection`), which shuffles counts of bins.

Splits and leaves are small tables, joined to the rows without moving them as long
as Spark finds them small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pinball
from ..operators.selection import group_quantiles, order_statistics
from ..session import materialize
from .boosting_kernel import FEATURE_GAP, PRIME, stage_factors

BLOCKS = 64


def in_bag(task: str, position: str, config: str, stage: int, seeds: list[int]) -> Column:
    """The draw of :func:`boosting_kernel.in_bag` as a column; ``seeds`` are the seeds that occur."""
    p = F.lit(PRIME)
    first = (F.col(position) % p * 1103515245 + F.crc32(F.col(task).cast("binary")) % p) % p
    drawn = F.lit(None).cast("long")
    for seed in seeds:
        factor, offset = stage_factors(seed, stage)
        drawn = F.when(F.col(f"{config}.seed") == seed, (first * first % p * factor + offset) % p).otherwise(drawn)
    return (F.col(f"{config}.subsample") >= 1) | (drawn < F.col(f"{config}.subsample") * p)


def gain(n1: str, u1: str, m: str, total: str) -> str:
    """SQL of the gain that separates n1 rows, u1 of them upper, from m rows, total of them upper."""
    return f"pow(CAST({u1} * {m} - {total} * {n1} AS double), 2) / CAST({n1} * ({m} - {n1}) AS double)"


class LargeModels:
    """Trees of all ``tasks`` (task, series_id, lo, hi, start, stop, config) over ``rows`` (series_id, position, label, x)."""

    def __init__(self, rows: DataFrame, tasks: DataFrame, alpha: float, track: bool, blocks: int = BLOCKS,
                 small: int = 4096) -> None:
        self.alpha, self.track, self.blocks, self.small = alpha, track, blocks, small
        held = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop"))
        train = (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi"))
        # large tasks are few; their training sets are the rows of the model, whichever engine grows it
        state = (
            rows.join(tasks, "series_id")
            .filter(train | held)
            .select("task", "position", "label", "x", "config", train.alias("is_train"), held.alias("is_held"))
        )
        state = materialize(state, "boosting-rows")
        learn = state.filter("is_train")
        self.start = materialize(
            group_quantiles(learn, ["task"], "label", alpha, small=small).withColumnRenamed("quantile", "value"), "boosting-start"
        )
        width = len(rows.select("x").first()[0])
        steps = [i / blocks for i in range(1, blocks)]
        cuts = learn.groupBy("task").agg(
            F.array(*[F.array_distinct(F.percentile_approx(F.col("x")[i], steps, 1000)) for i in range(width)]).alias("cuts")
        )
        place = F.transform(
            F.arrays_zip(F.col("x").alias("v"), F.col("cuts").alias("c")), lambda f: F.size(F.filter(f["c"], lambda cut: cut < f["v"]))
        )
        self.state = materialize(
            state.join(cuts, "task").withColumn("blocks", place).join(self.start, "task")
            .withColumnRenamed("value", "prediction").drop("cuts"),
            "boosting-state",
        )
        self.seeds = [r[0] for r in tasks.select("config.seed").distinct().collect()]
        self.nodes: list[DataFrame] = []
        self.losses: list[DataFrame] = []
        if track:
            self._loss(0)

    def _loss(self, stage: int) -> None:
        loss = pinball(F.col("label"), F.col("prediction"), self.alpha)
        self.losses.append(
            materialize(
                self.state.groupBy("task").agg(
                    F.avg(F.when(F.col("is_train"), loss)).alias("value"), F.avg(F.when(F.col("is_held"), loss)).alias("more")
                ).withColumn("stage", F.lit(stage)),
                "boosting-loss",
            )
        )

    def _splits(self, rows: DataFrame, level: int) -> DataFrame:
        """task, node, feature and threshold of the best split of every open node."""
        open_rows = rows.filter(f"bagged AND node >= {2**level} AND {level} < config.max_depth").selectExpr(
            "task", "node", "config.min_leaf AS min_leaf", "label >= prediction AS up",
            "inline(transform(filter(sequence(0, size(x) - 1), i -> array_contains(config.used, i)), "
            "i -> struct(i AS feature, blocks[i] AS block, x[i] AS v)))",
        )
        cell = ["task", "node", "feature"]
        counted = materialize(
            open_rows.groupBy(*cell, "block").agg(
                F.count("*").alias("n"), F.count_if("up").alias("u"), F.min("v").alias("low"), F.max("v").alias("high"),
                F.first("min_leaf").alias("min_leaf"),
            ),
            "boosting-cells",
        )
        over = "OVER (PARTITION BY task, node, feature ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
        whole, here = over.format("UNBOUNDED FOLLOWING"), over.format("CURRENT ROW")
        along = "OVER (PARTITION BY task, node, feature ORDER BY block)"
        sides = counted.selectExpr(
            "*", f"sum(n) {here} AS n1", f"sum(u) {here} AS u1", f"sum(n) {whole} AS m", f"sum(u) {whole} AS total",
            f"lead(low) {along} AS beyond",
        ).filter("total > 0 AND total < m AND m >= 2 * min_leaf")
        fits = "n1 >= min_leaf AND m - n1 >= min_leaf"
        between = sides.filter(f"{fits} AND beyond > high + {FEATURE_GAP}").selectExpr(
            *cell, f"{gain('n1', 'u1', 'm', 'total')} AS gain", "high AS low", "beyond AS high"
        )
        reached = between.groupBy("task", "node").agg(F.max("gain").alias("reached"))
        # the corners: none of the block, its upper rows only, its lower rows only, all of it; m rows on one side give no bound
        corners = [("n1 - n", "u1 - u"), ("n1 - n + u", "u1"), ("n1 - u", "u1 - u"), ("n1", "u1")]
        bound = ", ".join(f"CASE WHEN {a} BETWEEN 1 AND m - 1 THEN {gain(f'({a})', f'({b})', 'm', 'total')} ELSE 0D END" for a, b in corners)
        promising = materialize(
            sides.filter(f"high > low + {FEATURE_GAP}")
            .withColumn("bound", F.expr(f"greatest({bound})"))
            .join(reached, ["task", "node"], "left")
            # equal gains go to the lower feature or threshold, and the bound is rounded: both stay in
            .filter("bound * 1.0000001 >= coalesce(reached, 0D)")
            .selectExpr(*cell, "block", "n1 - n AS n0", "u1 - u AS u0", "m", "total", "min_leaf"),
            "boosting-promising",
        )
        inner = (
            open_rows.select(*cell, "block", "v", "up").join(promising, [*cell, "block"])
            .groupBy(*cell, "block", "v", "n0", "u0", "m", "total", "min_leaf")
            .agg(F.count("*").alias("n"), F.count_if("up").alias("u"))
        )
        block = "OVER (PARTITION BY task, node, feature, block ORDER BY v"
        within = inner.selectExpr(
            *cell, "v AS low", "m", "total", "min_leaf",
            f"n0 + sum(n) {block} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n1",
            f"u0 + sum(u) {block} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u1", f"lead(v) {block}) AS high",
        ).filter(f"{fits} AND high > low + {FEATURE_GAP}").selectExpr(
            *cell, f"{gain('n1', 'u1', 'm', 'total')} AS gain", "low", "high"
        )
        best = between.unionByName(within).groupBy("task", "node").agg(
            F.expr("max(struct(gain, -feature AS f, -low AS l, high))").alias("best")
        )
        middle = "-best.l / 2 + best.high / 2"
        return best.selectExpr(
            "task", "node", "-best.f AS feature", f"CASE WHEN {middle} >= best.high THEN -best.l ELSE {middle} END AS threshold"
        )

    def grow(self, stage: int, depth: int) -> None:
        """Add one tree to every task that has stages left."""
        grows = F.col("config.stages") >= stage
        rows = self.state.withColumns(
            {"node": F.lit(1), "bagged": F.col("is_train") & grows & in_bag("task", "position", "config", stage, self.seeds)}
        )
        for level in range(depth):
            splits = materialize(self._splits(rows, level), "boosting-splits")
            self.nodes.append(splits.selectExpr(f"{stage} AS stage", "task", "node", "feature", "threshold AS value"))
            below = "node * 2 + CAST(get(x, feature) > threshold AS int)"
            rows = rows.join(splits, ["task", "node"], "left").withColumn(
                "node", F.expr(f"CASE WHEN feature IS NULL THEN node ELSE {below} END")
            ).drop("feature", "threshold")
        residuals = rows.filter("bagged").selectExpr("task", "node", "label - prediction AS residual", "config")
        leaf = ["task", "node"]
        ranks = residuals.groupBy(*leaf).agg(
            F.greatest(F.lit(1), F.ceil(F.lit(self.alpha) * F.count("*") - 1e-9)).cast("long").alias("rank"),
            F.first("config.learning_rate").alias("rate"),
        )
        steps = materialize(
            order_statistics(residuals, ranks, leaf, "residual", small=self.small).selectExpr(*leaf, "selected * rate AS step"), "boosting-leaves"
        )
        self.nodes.append(steps.selectExpr(f"{stage} AS stage", *leaf, "CAST(NULL AS int) AS feature", "step AS value"))
        moved = rows.join(steps, leaf, "left").withColumn("prediction", F.expr("prediction + coalesce(step, 0D)"))
        self.state = materialize(moved.select(*self.state.columns), "boosting-state")
        if self.track:
            self._loss(stage)

    def results(self) -> DataFrame:
        """The rows that small models give, in the same columns."""
        missing = {"stage": "int", "node": "int", "feature": "int", "position": "long", "value": "double", "more": "double"}

        def shaped(kind: str, df: DataFrame) -> DataFrame:
            columns = [F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in missing.items()]
            return df.select("task", F.lit(kind).alias("kind"), *[x.alias(c) for x, c in zip(columns, missing)])

        out = shaped("start", self.start).unionByName(
            shaped("prediction", self.state.filter("is_held").withColumnRenamed("prediction", "value"))
        )
        for df in self.nodes:
            out = out.unionByName(shaped("node", df))
        for df in self.losses:
            out = out.unionByName(shaped("loss", df))
        return out
