"""Growing the trees of one model on arrays, for models whose rows fit a task.

The rules are those of :mod:`quantile_boosting`; tests hold this, the distributed
loop and a plain version against each other.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Fixed value: neighbouring feature values this close are not separated.
FEATURE_GAP = 1e-7
PRIME = 2**31 - 1


def stage_factors(seed: int, stage: int) -> tuple[int, int]:
    """Factor and offset of a stage's row draws, both below PRIME."""
    mixed = zlib.crc32(f"{seed}/{stage}".encode())
    return 1 + mixed % (PRIME - 1), zlib.crc32(f"{stage}/{seed}".encode()) % PRIME


def in_bag(task: str, positions: np.ndarray, seed: int, stage: int, share: float) -> np.ndarray:
    """Which rows a stage learns from: a hash of task, stage and row below ``share`` of its range."""
    factor, offset = stage_factors(seed, stage)
    first = (positions.astype(np.int64) % PRIME * 1103515245 + zlib.crc32(task.encode()) % PRIME) % PRIME
    return (first * first % PRIME * factor + offset) % PRIME < share * PRIME


def linear_quantile(values: np.ndarray, alpha: float) -> float:
    ranked = np.sort(values)
    at = alpha * (len(ranked) - 1)
    low = int(math.floor(at))
    high = min(low + 1, len(ranked) - 1)
    return float(ranked[low] + (at - low) * (ranked[high] - ranked[low]))


def leaf_rank(rows: int, alpha: float) -> int:
    """1-based rank of the leaf's quantile: the least one that covers ``alpha`` of the rows."""
    return max(1, math.ceil(alpha * rows - 1e-9))


def separable(values: np.ndarray, min_leaf: int) -> np.ndarray:
    """After which of its sorted values (features by rows) a node may be cut."""
    cuts = values[:, 1:] > values[:, :-1] + FEATURE_GAP
    cuts[:, : min_leaf - 1] = False
    cuts[:, values.shape[1] - min_leaf :] = False
    return cuts


def best_split(x: np.ndarray, ranked: np.ndarray, up: np.ndarray, min_leaf: int,
               known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[int, float] | None:
    """Feature and threshold of the best split; ``ranked`` holds a node's rows in the order of each feature.

    ``known`` are the node's sorted values and where they may be cut, if they are known already.

    The residual takes two values, so counts of the upper one give exact integers;
    ties go to the first feature and then to the lowest threshold.
    """
    m = ranked.shape[1]
    total = int(up[ranked[0]].sum()) if m >= 2 * min_leaf else 0
    if m < 2 * min_leaf or total in (0, m):
        return None
    if known is None:
        values = np.take_along_axis(x, ranked, 1)
        known = values, separable(values, min_leaf)
    values, cuts = known
    n1 = np.arange(1, m)
    u1 = np.cumsum(up[ranked], axis=1)[:, :-1]
    gain = np.where(cuts, (u1 * m - total * n1).astype(float) ** 2 / (n1 * (m - n1)).astype(float), -1.0)
    best = int(gain.argmax())
    feature, at = divmod(best, m - 1)
    if gain[feature, at] < 0:
        return None
    low, high = float(values[feature, at]), float(values[feature, at + 1])
    middle = low / 2 + high / 2
    return feature, low if middle >= high else middle


@dataclass
class Grown:
    start: float
    nodes: list[tuple[int, int, int | None, float]]  # stage, node, feature (None: leaf), threshold or step
    predicted: np.ndarray
    losses: list[tuple[int, float, float]]


def pinball_mean(y: np.ndarray, q: np.ndarray, alpha: float) -> float:
    return float(np.maximum(alpha * (y - q), (alpha - 1) * (y - q)).mean()) if len(y) else math.nan


def grow(x: np.ndarray, order: np.ndarray, y: np.ndarray, positions: np.ndarray, train: slice, held: slice, task: str,
         stages: int, learning_rate: float, max_depth: int, min_leaf: int, subsample: float, seed: int,
         used: list[int], alpha: float, track: bool) -> Grown:
    """Boost on the rows of ``train``, predict those of ``held``; x is features by rows, order its sorted row numbers."""
    chosen = order[used]
    inside = (chosen >= train.start) & (chosen < train.stop)
    rows = train.stop - train.start
    base = (chosen[inside].reshape(len(used), rows) - train.start).astype(np.int32)
    xs, ys, xv, yv = x[used][:, train], y[train], x[used][:, held], y[held]
    values = np.take_along_axis(xs, base, 1)
    root = values, separable(values, min_leaf) if rows > 1 else values
    start = linear_quantile(ys, alpha)
    fitted, predicted = np.full(rows, start), np.full(len(yv), start)
    grown = Grown(start, [], predicted, [])

    def leaves(stage: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        up = ys >= fitted
        ranked = base
        if subsample < 1:
            bag = in_bag(task, positions[train], seed, stage, subsample)
            ranked = base[bag[base]].reshape(len(used), int(bag.sum()))
        nodes = [(1, ranked, np.arange(rows), np.arange(len(yv)))]
        for level in range(max_depth + 1):
            below = []
            for node, members, own, later in nodes:
                known = root if level == 0 and subsample >= 1 else None
                cut = best_split(xs, members, up, min_leaf, known) if level < max_depth else None
                if cut is None:
                    yield node, members[0], own, later
                    continue
                feature, threshold = cut
                grown.nodes.append((stage, node, used[feature], threshold))
                left = xs[feature] <= threshold
                kept, down, out = left[members], left[own], xv[feature, later] <= threshold
                below.append((2 * node, members[kept].reshape(len(used), -1), own[down], later[out]))
                below.append((2 * node + 1, members[~kept].reshape(len(used), -1), own[~down], later[~out]))
            nodes = below

    if track:
        grown.losses.append((0, pinball_mean(ys, fitted, alpha), pinball_mean(yv, predicted, alpha)))
    for stage in range(1, stages + 1):
        for node, members, own, later in list(leaves(stage)):
            if not len(members):
                continue  # a stage whose bag is empty adds nothing
            rank = leaf_rank(len(members), alpha) - 1
            step = float(np.partition(ys[members] - fitted[members], rank)[rank]) * learning_rate
            grown.nodes.append((stage, node, None, step))
            fitted[own] += step
            predicted[later] += step
        if track:
            grown.losses.append((stage, pinball_mean(ys, fitted, alpha), pinball_mean(yv, predicted, alpha)))
    return grown
