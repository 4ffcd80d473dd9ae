"""Embedding near-duplicates against brute force, with one shard and with many."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tailgauge.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, node string, shard int, root string"


def some_rows():
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        label = int(rng.integers(0, 3)) if i % 40 else None
        rows.append((i, rng.normal(size=12).tolist(), label))
    centre = rng.normal(size=12)
    for i in range(300, 420):  # one large group of near copies
        rows.append((i, (centre + rng.normal(size=12) * 0.05).tolist(), 1))
    chain = rng.normal(size=12)
    for i in range(500, 530):  # neighbours are linked, ends are not
        chain = chain + rng.normal(size=12) * 0.22
        rows.append((i, chain.tolist(), 2))
    rows += [(600 + i, rows[7][1], rows[7][2]) for i in range(9)]  # copies
    rows += [(700, (2.5 * np.array(rows[8][1])).tolist(), rows[8][2]), (701, rows[8][1], 9), rows[11], rows[11]]
    rows += [(None, rows[12][1], rows[12][2]), (None, [1.0] * 12, 7)]
    bad = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [None] + [1.0] * 11, [-0.0] * 12]
    rows += [(800 + i, x, 1) for i, x in enumerate(bad + bad)]
    rows += [(820, [1.0, 2.0], 1), (821, [1.0, 2.0], 1), (822, [1.0], 1), (823, [5.0], 1), (824, [0.0, -0.0, 3.0], 1), (825, [-0.0, 0.0, 4.0], 1)]
    return rows


def brute_force(rows, similarity=0.93):
    n = len(rows)
    fine = [
        e is not None and len(e) > 0 and lab is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)
        for _, e, lab in rows
    ]
    wide = [np.array(e, np.float32).astype(float) if ok else None for (_, e, _), ok in zip(rows, fine)]
    unit = [None if e is None else e / np.linalg.norm(e) for e in wide]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if float(unit[i] @ unit[j]) >= similarity:
                    links[i].append(j)
                    links[j].append(i)
    part = [-1] * n
    for s in range(n):
        stack = [s] if part[s] < 0 else []
        while stack:
            x = stack.pop()
            if part[x] < 0:
                part[x] = s
                stack += links[x]
    least = {}
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            least[p] = min(least.get(p, rows[i][0]), rows[i][0])
    return Counter((r[0], len(links[i]), least.get(part[i]), r[0] == least.get(part[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("shard_rows", [8192, 40])
def test_links_and_components_equal_brute_force(spark, shard_rows):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "n", 1, "r") for r in rows], SCHEMA).repartition(5)
    settings = hnsw.Settings(shard_rows=shard_rows)
    got = Counter(tuple(r) for r in hnsw.near_duplicates(df, settings).collect())
    assert got == brute_force(rows)
    found = hnsw.audits(df, settings).collect()
    assert sum(r.hit for r in found) >= 0.98 * sum(r.audited for r in found) > 100
    assert len(found) == 8 if shard_rows == 8192 else len(found) > 8


def test_double_vectors_far_out(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e-300, 1.01e-300], 0), (3, [1.0, -1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in hnsw.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_empty_table(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def graph_of(vectors, width=6, beam=16):
    levels = np.minimum(-np.log(np.random.default_rng(1).random(len(vectors))) / np.log(width), 8).astype(np.int64)
    return hnsw.Graph.built(hnsw.unit(vectors), levels, width, beam)


def test_graph_reaches_every_node_and_survives_bytes():
    rng = np.random.default_rng(2)
    tight = rng.normal(size=8) + rng.normal(size=(200, 8)) * 1e-3
    vectors = np.concatenate([rng.normal(size=(600, 8)), tight, -tight])
    graph = hnsw.Graph.from_bytes(graph_of(vectors).to_bytes())
    reached = np.zeros(len(vectors), bool)
    graph._reach(reached, np.array([graph.entry]))
    assert reached.all()
    nearest = graph.vectors @ graph.vectors.T
    for i in range(0, 1000, 37):
        nodes, _ = graph.search(graph.vectors[i], np.append(graph.descend(graph.vectors[i], 0), graph.entry), len(vectors), 0)
        assert len(nodes) == len(vectors)  # a beam as wide as the shard is exhaustive
        assert graph.within(graph.vectors[i], 0.99, 8)[0].size == (nearest[i] >= 0.99).sum()


def test_a_failed_audit_widens_the_beam():
    rng = np.random.default_rng(3)
    graph = graph_of(rng.normal(size=(700, 30)), width=2, beam=2)
    settings = hnsw.Settings(similarity=0.4, beam=1, recall=1.0)
    found, truth, hit, beam = hnsw.links_between(graph, graph, True, settings)
    assert beam > 1 and hit == truth > 50 and (found == found.T).all()
