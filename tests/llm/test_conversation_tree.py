"""The prefix tree against one built in plain Python, and the list ranking against walking the list."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from tailgauge.llm import conversation_tree as tree

SCHEMA = "conv_id long, turn long, role string, text string, part string, k1 string, total int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_tree(rows):
    """Rows must not tie in (conv_id, turn) unless they are equal."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[x] for x in children[key]) or 1
        own_bytes = (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        saved[key] = own_bytes + sum(saved[x] for x in children[key])
    return Counter(
        (
            min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest(),
        )
        for k in members
    )


def some_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 10**12, 10**12 + 3]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 12])
        for i in range(n):
            text = "hello" if i == 0 and rng.random() < 0.5 else rng.choice(["a", "bb", "ä😀", "", None, "long " * 30])
            rows.append((c, None if i == 0 and rng.random() < 0.3 else i * 3, rng.choice(["user", None]) if i % 2 else "user", text, "p", "k", 1))
    rows += [(17, 99, "user", f"turn {i}", "p", "k", 1) for i in range(1)]
    rows += [(18, i + 100, "user", f"turn {i % 7}", "p", "k", 1) for i in range(300)]  # a long one
    rows += [(19, 50, "user", "again", "p", "k", 1)] * 3  # rows that repeat
    rows += [(None, 1, "user", "nobody", "p", "k", 1)]
    return [r for r in rows if r[0] not in (5, 10)]  # two bases are absent


@pytest.mark.parametrize("block_turns, block_arcs", [(1024, 1 << 16), (7, 40), (1, 3)])
def test_nodes_equal_the_plain_tree(spark, monkeypatch, block_turns, block_arcs):
    monkeypatch.setattr(tree, "BLOCK_TURNS", block_turns)
    rows = some_rows()
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = tree.prefix_tree(df, block=block_arcs)
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain_tree(rows)
    positions = sorted(r.tour_position for r in got.collect())
    assert len(set(positions)) == len(positions) and positions[0] == 0


def test_one_conversation_and_none(spark):
    one = [(3, 0, None, None, "p", "k", 1)]
    got = tree.prefix_tree(spark.createDataFrame(one, SCHEMA))
    assert Counter(tuple(r) for r in got.select(*COLUMNS).collect()) == plain_tree(one)
    assert tree.prefix_tree(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tree.prefix_tree(spark.createDataFrame([(None, 0, "a", "b", "p", "k", 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("n, block, shuffled", [(1, 10, False), (500, 37, False), (300, 11, True)])
def test_list_rank_equals_walking(spark, n, block, shuffled):
    rng = random.Random(n)
    ids = [(i // 7, i % 7, i % 2) for i in range(n)]
    if shuffled:
        rng.shuffle(ids)  # ranges do not shorten such a list: pointer jumping
    rows, want, sums = [], {}, (0, 0, 0)
    for i, x in enumerate(ids):
        weights = (1, rng.randint(0, 3), rng.randint(0, 50))
        rows.append((*x, *(ids[i + 1] if i + 1 < n else (None, None, None)), *weights))
        want[x] = sums
        sums = tuple(a + b for a, b in zip(sums, weights))
    elements = spark.createDataFrame(rows, tree.ELEMENT).repartition(4)
    got = {tuple(r[:3]): tuple(r[3:]) for r in tree.list_rank(elements, block).collect()}
    assert got == want
