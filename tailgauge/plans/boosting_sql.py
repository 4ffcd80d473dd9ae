"""SQL of boosted quantile trees: every stage is one step of a recursive query over the rows of all tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from ..models.boosting_kernel import FEATURE_GAP
from ..models.quantile_boosting import Candidate

ALPHA = 0.05


def _level(k: int) -> str:
    """The best split of every node at depth k, and the rows one level further down."""
    per = "PARTITION BY task, node, f"
    return f"""
    c{k} AS MATERIALIZED (
      SELECT n.task, n.node, c.f, c.v, count(*) AS k, count(*) FILTER (n.y >= n.p) AS u, any_value(n.min_leaf) AS min_leaf
      FROM n{k} n JOIN cells c USING (r) WHERE n.tr AND {k} < n.depth GROUP BY ALL
    ),
    s{k} AS MATERIALIZED (
      SELECT task, node, f, CASE WHEN v / 2 + nx / 2 >= nx THEN v ELSE v / 2 + nx / 2 END AS cut FROM (
        SELECT *, pow(CAST(u1 * m - tot * n1 AS DOUBLE), 2) / CAST(n1 * (m - n1) AS DOUBLE) AS gain FROM (
          SELECT *, sum(k) OVER ({per} ORDER BY v) AS n1, sum(u) OVER ({per} ORDER BY v) AS u1, sum(k) OVER ({per}) AS m,
            sum(u) OVER ({per}) AS tot, lead(v) OVER ({per} ORDER BY v) AS nx FROM c{k})
        WHERE nx > v + {FEATURE_GAP} AND n1 >= min_leaf AND m - n1 >= min_leaf AND tot > 0 AND tot < m)
      QUALIFY row_number() OVER (PARTITION BY task, node ORDER BY gain DESC, f, v) = 1
    ),
    n{k + 1} AS MATERIALIZED (
      SELECT n.* REPLACE (CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + CAST(n.x[s.f] > s.cut AS INTEGER) END AS node)
      FROM n{k} n LEFT JOIN s{k} s ON s.task = n.task AND s.node = n.node
    ),"""


def candidates(grid: Mapping[str, Candidate], columns: Sequence[str]) -> str:
    rows = []
    for name, c in grid.items():
        used = [list(columns).index(f) + 1 for f in (c.features or columns)]
        rows.append(f"('{name}', {c.stages}, {c.learning_rate!r}e0, {c.max_depth}, {c.min_leaf}, {used})")
    return f"(VALUES {', '.join(rows)}) AS g(candidate, stages, rate, depth, min_leaf, used)"


#: Ranges of positions by kind of task; ``pos`` has the position and the number of rows of each series.
TASKS = {
    "folds": "SELECT DISTINCT series_id, CAST(fold AS VARCHAR) AS part, 0 AS lo, n - (6 - fold) * (n // 6) AS hi, "
    "n - (6 - fold) * (n // 6) AS start, n - (5 - fold) * (n // 6) AS stop FROM pos, range(1, 6) AS t(fold) WHERE n >= 6",
    "whole": "SELECT DISTINCT series_id, 'all' AS part, 0 AS lo, n AS hi, 0 AS start, n AS stop FROM pos",
}


def holdout_tasks(end: str) -> str:
    return (
        f"SELECT series_id, 'holdout' AS part, 0 AS lo, count(*) FILTER (target_date <= DATE '{end}') AS hi, "
        f"count(*) FILTER (target_date <= DATE '{end}') AS start, count(*) AS stop FROM pos GROUP BY 1"
    )


def development_tasks(end: str) -> str:
    """Trained on the development rows, asked about all rows."""
    return (
        f"SELECT series_id, 'all' AS part, 0 AS lo, count(*) FILTER (target_date <= DATE '{end}') AS hi, 0 AS start, "
        "count(*) AS stop FROM pos GROUP BY 1"
    )


def refit_tasks(first: int, every: int, rolling: int | None = None) -> str:
    lo = "0" if rolling is None else f"greatest(0, {first} + k * {every} - {rolling})"
    return (
        f"SELECT series_id, CAST(k AS VARCHAR) AS part, {lo} AS lo, {first} + k * {every} AS hi, {first} + k * {every} AS start, "
        f"least({first} + (k + 1) * {every}, n) AS stop FROM (SELECT DISTINCT series_id, n FROM pos WHERE n > {first}), "
        f"range(0, (n - 1 - {first}) // {every} + 1) AS t(k)"
    )


def boosted(tasks: str, grid: Mapping[str, Candidate], columns: Sequence[str], result: str, features: str = "feat12",
            asked: str = "FALSE") -> str:
    """``result`` is a SELECT over ``base`` (rows of tasks) and ``state`` (stage, r, p: the prediction after it).

    ``asked`` is a condition on ``pos`` of rows that are predicted for every task of their series, beside its range.
    """
    depth = max(c.max_depth for c in grid.values())
    vector = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE)" for c in columns)
    return f"""WITH RECURSIVE pos AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY target_date) - 1 AS position,
      count(*) FILTER (NOT coming) OVER (PARTITION BY series_id) AS n
    FROM (SELECT series_id, target_date, as_of, actual_return AS y, [{vector}] AS x, {asked} AS coming FROM {features})
  ),
  base AS MATERIALIZED (
    SELECT row_number() OVER () AS r, * FROM (
      SELECT t.series_id || '/' || t.part || '/' || g.candidate AS task, t.part, p.series_id, p.target_date, p.as_of, p.y, p.x,
        NOT coming AND position >= lo AND position < hi AS tr, coming OR position >= start AND position < stop AS held,
        g.candidate, g.stages, g.rate, g.depth, g.min_leaf, g.used, coming
      FROM pos p JOIN ({tasks}) t ON t.series_id = p.series_id, {candidates(grid, columns)}) WHERE tr OR held
  ),
  cells AS MATERIALIZED (SELECT r, f, x[f] AS v FROM (SELECT r, x, unnest(used) AS f FROM base WHERE tr)),
  state AS (
    SELECT 0 AS stage, r, q AS p FROM base JOIN (
      SELECT task, quantile_cont(y, {ALPHA}) AS q FROM base WHERE tr GROUP BY 1) USING (task)
    UNION ALL
    SELECT * FROM (WITH n0 AS MATERIALIZED (
      SELECT b.r, b.task, b.y, b.x, b.tr, b.rate, b.depth, b.min_leaf, s.stage, s.p, 1 AS node
      FROM state s JOIN base b USING (r) WHERE s.stage < b.stages
    ),{''.join(_level(k) for k in range(depth))}
    leaves AS (
      SELECT task, node, list_sort(list(y - p))[CAST(greatest(1, ceil({ALPHA} * count(*) - 1e-9)) AS INTEGER)] * any_value(rate) AS step
      FROM n{depth} WHERE tr GROUP BY ALL
    )
    SELECT stage + 1, r, p + coalesce(step, 0) FROM n{depth} LEFT JOIN leaves USING (task, node))
  )
  {result}"""


FINAL = "state JOIN base USING (r) WHERE stage = stages AND held"


def predictions(key: str) -> str:
    return f"""SELECT series_id, candidate AS model, part AS "{key}", as_of, target_date, y AS actual_return,
    p AS quantile_return, greatest(0e0, -p) AS var, y < p AS violation FROM {FINAL}"""
