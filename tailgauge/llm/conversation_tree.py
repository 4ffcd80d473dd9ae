"""Prefix tree of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations
that begin with it, and (least member, depth) names it.  Sequences are compared by
128 bits: every turn's role and text give two 64-bit hashes with its depth, and
the key of a sequence is the exclusive or of its turns' hashes.

Each node has an enter and an exit arc.  The successor of an enter arc enters the
first child, or leaves the node; the successor of an exit arc enters the next
sibling, or leaves the parent; siblings stand in the order of their least members.
The tour is one list, which :func:`list_rank` ranks distributedly: tasks contract
the stretches of the list that lie in their range of (conversation, depth), the
stretches form a shorter list, which is ranked in the same way (or by pointer
jumping where ranges do not shorten it), and prefix sums are handed back.  The
sums of a subtree are a difference of the prefix sums at its two arcs.

Hot groups: a long conversation is numbered and hashed in range partitions and
blocks with carried sums; the children of a node are linked in range partitions;
members are counted with partial aggregates; the ids that end in one node are
joined to pieces in range partitions and hashed as a stream.

Turns are in the order of ``turn`` (null first); turns that tie are in the order of
role, then of the hashes of their texts; rows that repeat are turns of their own.
Null role and text are empty.  Rows without a conv_id belong to no conversation.
An empty table has no conversation and gives an empty result.  Texts are read once
and hashed, whatever their length; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .columns import checked, ship

BLOCK_TURNS = 1024
BLOCK_ARCS = 1 << 16
ID = ("conv_id", "depth", "side")
NEXT = ("next_conv", "next_depth", "next_side")
HEAD = ("head_conv", "head_depth", "head_side")
SUMS = ("arcs", "leaves", "saved")


def in_ranges(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """The rows in range partitions of ``order``; ``part`` numbers the partitions in that order."""
    return materialize(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, two hashes of role and text, and the bytes of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return (
        checked(conversations, "conv_id", "turn", "role", "text")
        .where("conv_id IS NOT NULL")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
            F.xxhash64(role, text).alias("x"), F.xxhash64(F.lit("second"), text, role).alias("y"),
            F.octet_length(text).cast("long").alias("bytes"),
        )
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, x, y, bytes, total) of every rebuilt turn, depth from 1, and (conv_id, total) of every conversation.

    Conversation c takes the first h turns of conversation c - c % 5 and its own
    turns after its first h; h is the crc32 of its decimal id modulo 9.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("x"), F.asc("y")]
    ranged = in_ranges(hashed_turns(conversations), [F.asc("conv_id"), *order], "turns-ranged")
    counts = materialize(ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "turns-counts")
    lengths = counts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    plan = lengths.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"),
    )
    donors = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("given"))
    plan = materialize(
        plan.join(donors, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
        .select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")),
        "turns-plan",
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("conv_id", "part").orderBy(*order)
    placed = materialize(
        ranged.join(before.join(plan, "conv_id"), ["conv_id", "part"]).select(
            "conv_id", (F.col("before") + F.row_number().over(here) - 1).alias("place"), "x", "y", "bytes", "h", "taken", "total"
        ),
        "turns-placed",
    )
    own = placed.where("place >= h").withColumn("depth", F.expr("taken + place - h + 1"))
    gifts = placed.where("place < 8 AND conv_id % 5 = 0").select(F.col("conv_id").alias("base"), "place", "x", "y", "bytes")
    given = gifts.join(plan, "base").where("place < h").withColumn("depth", F.col("place") + 1)
    columns = ["conv_id", "depth", "x", "y", "bytes", "total"]
    return own.select(*columns).unionByName(given.select(*columns)), plan.select("conv_id", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """Keys k1, k2 of the sequence that ends with each turn, and p1, p2 of the one before it."""
    block = F.expr(f"(depth - 1) div {BLOCK_TURNS}").alias("block")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    marked = turns.select(
        "conv_id", "depth", "bytes", (F.col("depth") == F.col("total")).alias("ends"), block,
        F.xxhash64("x", "y", "depth").alias("z1"), F.xxhash64("y", "x", "depth").alias("z2"),
    )
    inner = materialize(
        marked.withColumns({f"k{i}": F.bit_xor(f"z{i}").over(so_far) for i in (1, 2)}), "turns-prefixes"
    )
    # what a block begins with: the exclusive or of all full blocks before it
    full = inner.where(F.col("depth") % BLOCK_TURNS == 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    carried = full.select(
        "conv_id", (F.col("block") + 1).alias("block"), *[F.bit_xor(f"k{i}").over(earlier).alias(f"c{i}") for i in (1, 2)]
    )
    whole = {f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(F.col(f"c{i}"), F.lit(0))) for i in (1, 2)}
    return (
        inner.join(carried, ["conv_id", "block"], "left")
        .withColumns(whole)
        .select("conv_id", "depth", "bytes", "ends", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i in (1, 2)])
    )


def tree_nodes(members: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, bytes, k1 and k2 of every node, the root included."""
    below = materialize(
        members.groupBy("depth", "k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
            F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        ),
        "tree-below",
    )
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", zero.alias("bytes"),
        zero.alias("k1"), zero.alias("k2"),
    )
    parents = below.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    # the many nodes of depth 1 have the one root for a parent: they are not joined by its key
    least = conversations.agg(F.min("conv_id")).first()[0]
    first = below.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    later = below.where("depth > 1").join(parents, ["depth", "p1", "p2"])
    return materialize(
        root.unionByName(first.select(*root.columns)).unionByName(later.select(*root.columns)), "tree-nodes"
    )


def tour_arcs(nodes: DataFrame) -> DataFrame:
    """The arcs of the tour with their successors and weights; also ``n_children`` of the node."""
    below = nodes.where("depth > 0").select("conv_id", "depth", "parent_conv_id")
    family = ["depth", "parent_conv_id"]
    children = below.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(
        F.count("*").alias("n_children"), F.min("conv_id").alias("first_child")
    )
    ranged = in_ranges(below, [*family, "conv_id"], "tree-siblings")
    here = Window.partitionBy(*family, "part").orderBy("conv_id")
    later = Window.partitionBy(*family).orderBy("part")
    heads = ranged.groupBy(*family, "part").agg(F.min("conv_id").alias("head"))
    heads = heads.select(*family, "part", F.lead("head").over(later).alias("beyond"))
    siblings = ranged.join(heads, [*family, "part"]).select(
        "conv_id", "depth", F.coalesce(F.lead("conv_id").over(here), F.col("beyond")).alias("sibling")
    )
    linked = nodes.join(children, ["conv_id", "depth"], "left").join(siblings, ["conv_id", "depth"], "left")
    down, along = F.col("first_child"), F.col("sibling")
    leave = F.struct(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.lit(1).alias("s"))
    child = F.struct(down.alias("c"), (F.col("depth") + 1).alias("d"), F.lit(0).alias("s"))
    brother = F.struct(along.alias("c"), F.col("depth").alias("d"), F.lit(0).alias("s"))
    upward = F.struct(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d"), F.lit(1).alias("s"))
    enter = F.struct(
        F.lit(0).alias("side"), F.when(down.isNull(), leave).otherwise(child).alias("next"),
        F.when(down.isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    zero = F.lit(0).cast("long")
    leaving = F.struct(
        F.lit(1).alias("side"), F.when(along.isNotNull(), brother).otherwise(upward).alias("next"),
        zero.alias("leaves"), zero.alias("saved"),
    )
    return linked.select(
        "conv_id", "depth", F.coalesce("n_children", zero).alias("n_children"), F.explode(F.array(enter, leaving)).alias("arc")
    ).select(
        *ID[:2], F.col("arc.side").alias("side"), F.col("arc.next.c").alias(NEXT[0]), F.col("arc.next.d").alias(NEXT[1]),
        F.col("arc.next.s").alias(NEXT[2]), F.lit(1).cast("long").alias("arcs"), "arc.leaves", "arc.saved", "n_children",
    )


def contract(elements: pa.Table) -> pa.Table:
    """Follow the list inside one task: head, inclusive sums since the head and whether the stretch ends here."""
    conv, depth, side = (elements.column(c).to_numpy().astype(np.int64) for c in ID)
    order = np.lexsort((side, depth, conv))
    elements = elements.take(pa.array(order))
    conv, depth, side = conv[order], depth[order], side[order]
    target = [elements.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in NEXT]
    known = ~elements.column(NEXT[0]).combine_chunks().is_null().to_numpy(zero_copy_only=False)
    names, number = np.unique(conv, return_inverse=True)
    width = 2 * (max(int(depth.max()), int(target[1].max())) + 1)
    code = number * width + 2 * depth + side
    named = np.minimum(np.searchsorted(names, target[0]), len(names) - 1)
    known &= names[named] == target[0]
    wanted = named * width + 2 * target[1] + target[2]
    at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
    inside = known & (code[at] == wanted)
    # jump backwards until every element knows its head
    previous = np.full(len(code), -1)
    previous[at[inside]] = np.flatnonzero(inside)
    sums = np.stack([elements.column(c).to_numpy() for c in SUMS], 1).astype(np.int64)
    head = np.arange(len(code))
    while (moving := np.flatnonzero(previous >= 0)).size:
        back = previous[moving]
        sums[moving] += sums[back]
        head[moving] = head[back]
        previous[moving] = previous[back]
    columns = {c: elements.column(c) for c in (*ID, *NEXT, *SUMS)}
    columns |= dict(zip(HEAD, (pa.array(conv[head]), pa.array(depth[head]), pa.array(side[head], pa.int32()))))
    columns |= {f"in_{c}": pa.array(sums[:, k]) for k, c in enumerate(SUMS)}
    return pa.table(columns | {"tail": pa.array(~inside)})


_LONGS = ", ".join(f"{c} long" for c in SUMS)
ELEMENT = "conv_id long, depth long, side int, next_conv long, next_depth long, next_side int, " + _LONGS
STRETCH = ELEMENT + ", head_conv long, head_depth long, head_side int, " + ", ".join(f"in_{c} long" for c in SUMS) + ", tail boolean"


def stretches(elements: DataFrame, count: int, block: int) -> DataFrame:
    """Contract the list in ranges of about ``block`` elements; a list of up to ``block`` is one range."""
    ship(elements.sparkSession)
    rows = elements.select(*ID, *NEXT, *SUMS)
    ranges = rows.coalesce(1) if count <= block else rows.repartitionByRange(-(-count // block), *ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield from contract(pa.Table.from_batches(parts)).combine_chunks().to_batches(max_chunksize=1 << 16)

    return materialize(ranges.mapInArrow(run, STRETCH), "tour-stretches")


def jump(elements: DataFrame) -> DataFrame:
    """Exclusive prefix sums of a list by pointer jumping, a self-join on successors each round."""
    totals = elements.agg(*[F.sum(c).alias(c) for c in SUMS]).first()
    current = elements.select(*ID, *NEXT, *SUMS)
    while not current.where(F.col(NEXT[0]).isNotNull()).isEmpty():
        ahead = current.select(
            *[F.col(a).alias(b) for a, b in zip(ID, NEXT)], *[F.col(c).alias(f"then_{c}") for c in (*NEXT, *SUMS)]
        )
        current = materialize(
            current.where(F.col(NEXT[0]).isNotNull()).join(ahead, list(NEXT)).select(
                *ID, *[F.col(f"then_{c}").alias(c) for c in NEXT], *[(F.col(c) + F.col(f"then_{c}")).alias(c) for c in SUMS]
            ).unionByName(current.where(F.col(NEXT[0]).isNull())),
            "tour-jumps",
        )
    return current.select(*ID, *[(F.lit(totals[c]) - F.col(c)).alias(f"before_{c}") for c in SUMS])


def list_rank(elements: DataFrame, block: int = BLOCK_ARCS) -> DataFrame:
    """(conv_id, depth, side, before_arcs, before_leaves, before_saved): sums over all earlier elements of the list.

    ``elements`` is one list: id, id of the next element (null at the end) and the
    three weights.  Written tables hold the levels, so a lost executor costs at
    most one of them.
    """
    count = elements.count()
    inner = stretches(elements, count, block)
    runs = inner.where("tail").select(
        *[F.col(a).alias(b) for a, b in zip(HEAD, ID)], *NEXT, *[F.col(f"in_{c}").alias(c) for c in SUMS]
    )
    n_runs = runs.count()
    if n_runs <= 1:
        return inner.select(*ID, *[(F.col(f"in_{c}") - F.col(c)).alias(f"before_{c}") for c in SUMS])
    outer = list_rank(runs, block) if 2 * n_runs <= count else jump(runs)
    heads = outer.select(*[F.col(a).alias(b) for a, b in zip(ID, HEAD)], *[f"before_{c}" for c in SUMS])
    return inner.join(heads, list(HEAD)).select(
        *ID, *[(F.col(f"before_{c}") + F.col(f"in_{c}") - F.col(c)).alias(f"before_{c}") for c in SUMS]
    )


KEY = ("depth", "k1", "k2")
KEY_SCHEMA = "depth long, k1 long, k2 long"


def ending_digests(ended: DataFrame) -> DataFrame:
    """SHA-256 of the ascending comma-joined conv_ids that end in each node.

    Range partitions join ids to pieces of at most one batch; the pieces of a node
    then pass one task in order, which hashes them one after another.
    """
    ship(ended.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in KEY], 1)
            begins = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            ids = batch.column("conv_id").to_pylist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins, [*begins[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(keys[begins, k]) for k in range(3)], pa.array([ids[a] for a in begins], pa.int64()), pa.array(texts, pa.string())],
                names=[*KEY, "least", "ids"],
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            return pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in columns[:3]], pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"]
            )

        for batch in batches:
            found = []
            for *now, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        found.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
            if found:
                yield rows(found)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    listed = ended.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    cut = listed.mapInArrow(pieces, f"{KEY_SCHEMA}, least long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(digests, f"{KEY_SCHEMA}, ends_sha256 string")


def prefix_tree(conversations: DataFrame, block: int = BLOCK_ARCS) -> DataFrame:
    """One row per node: least member, depth, parent, members, children, leaves and saved bytes of its subtree,
    digest of the members that end there, and the place of its enter arc in the tour."""
    turns, known = rebuilt_turns(conversations)
    members = materialize(prefixes(turns), "tree-members")
    nodes = tree_nodes(members, known)
    arcs = materialize(tour_arcs(nodes), "tour-arcs")
    ranks = arcs.join(list_rank(arcs, block), list(ID))
    # prefix sum up to the exit arc less what came before the enter arc
    entering = F.col("side") == 0

    def subtree(name: str) -> Column:
        return F.sum(F.when(entering, -F.col(f"before_{name}")).otherwise(F.col(f"before_{name}") + F.col(name)))

    sums = ranks.groupBy("conv_id", "depth").agg(
        F.max("n_children").alias("n_children"), subtree("leaves").alias("n_leaves"), subtree("saved").alias("saved_tokens"),
        F.min("before_arcs").alias("tour_position"),
    )
    zero = F.lit(0).cast("long")
    turnless = known.where("total = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    ended = members.where("ends").select(*KEY, "conv_id").unionByName(turnless)
    return (
        nodes.join(sums, ["conv_id", "depth"])
        .join(ending_digests(ended), list(KEY), "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "tour_position",
        )
    )
