"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node before anything is compared.  The nodes of a label are
dealt to shards of bounded size; a task builds the graph of a shard (layers by a
hash of the node, neighbours chosen for diversity, nodes that pruning cut off
linked again).  Then every shard's nodes query every shard of their label: a pair
of shards is one task, which searches both ways with a beam, spreads from what it
found over all neighbours above the threshold (so a node may have any number of
links), and audits itself: the links of a sample of its nodes are counted exactly,
and while too few of them were found the beam is doubled and the search repeated.
At a beam as wide as the shard the search is exhaustive, so the audit passes.

A task returns a row for each linked node, its number of links and a root of its
component inside the pair; pairs of vectors never become rows.  Components of the
whole are unions of these.

The work of a label grows with its nodes times its shards, since every shard is
asked; a pair of shards costs two graphs in memory and one bit matrix.
"""

from __future__ import annotations

import heapq
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import checked, ship
from .components import connected_components

#: Similarities of the search differ from the checked ones by less than this.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """``shard_rows`` bounds the nodes of a shard, ``shard_bytes`` its vectors; ``audited`` the sample of an audit."""

    similarity: float = 0.93
    shard_rows: int = 8192
    shard_bytes: int = 32 << 20
    width: int = 16
    build_beam: int = 64
    beam: int = 32
    audited: int = 512
    recall: float = 0.98


class Graph:
    """A navigable small-world graph over unit vectors; node i has layers 0 to ``levels[i]``."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, width: int, beam: int) -> None:
        self.vectors, self.levels, self.width, self.beam = vectors, levels, width, beam
        n, layers = len(vectors), int(levels.max(initial=0)) + 1
        self.links = [np.full((n, 3 * width), -1, np.int32) for _ in range(layers)]
        self.degree = np.zeros((layers, n), np.int32)
        self.seen = np.zeros(n, np.int64)
        self.turn = 0
        self.entry = -1

    @classmethod
    def built(cls, vectors: np.ndarray, levels: np.ndarray, width: int, beam: int) -> Graph:
        graph = cls(vectors, levels, width, beam)
        for i in range(len(vectors)):
            graph.add(i)
        graph.connect()
        return graph

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        upper = [x[self.levels >= k + 1] for k, x in enumerate(self.links[1:])]
        np.savez(
            out, vectors=self.vectors, levels=self.levels, degree=self.degree, base=self.links[0],
            shape=np.array([self.width, self.beam, self.entry]), **{f"upper{k}": x for k, x in enumerate(upper)},
        )
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        kept = np.load(io.BytesIO(data))
        width, beam, entry = kept["shape"].tolist()
        graph = cls(kept["vectors"], kept["levels"], width, beam)
        graph.degree, graph.entry, graph.links[0] = kept["degree"], entry, kept["base"]
        for k in range(1, len(graph.links)):
            graph.links[k][graph.levels >= k] = kept[f"upper{k - 1}"]
        return graph

    def search(self, query: np.ndarray, entries, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes a beam ends with, most similar first, and their similarities."""
        self.turn += 1
        links, degree, seen, turn, vectors = self.links[layer], self.degree[layer], self.seen, self.turn, self.vectors
        entries = np.unique(entries)
        seen[entries] = turn
        best = list(zip((vectors[entries] @ query).tolist(), entries.tolist()))
        ahead = [(-s, i) for s, i in best]
        heapq.heapify(best)
        heapq.heapify(ahead)
        while len(best) > beam:
            heapq.heappop(best)
        while ahead:
            s, node = heapq.heappop(ahead)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = links[node, : degree[node]]
            near = near[seen[near] != turn]
            if not len(near):
                continue
            seen[near] = turn
            found = vectors[near] @ query
            if len(best) >= beam:
                good = found > best[0][0]
                near, found = near[good], found[good]
            for s, i in zip(found.tolist(), near.tolist()):
                if len(best) < beam:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(ahead, (-s, i))
        best.sort(reverse=True)
        return np.array([i for _, i in best], np.int64), np.array([s for s, _ in best])

    def descend(self, query: np.ndarray, layer: int) -> np.ndarray:
        at = np.array([self.entry])
        for k in range(int(self.levels[self.entry]), layer, -1):
            at = self.search(query, at, 1, k)[0]
        return at

    def diverse(self, nodes: np.ndarray, similarity: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of the nodes (most similar first): those nearer to the centre than to a chosen one, then others."""
        if len(nodes) <= most:
            return nodes
        own = self.vectors[nodes]
        among = own @ own.T
        nearest = np.full(len(nodes), -np.inf)
        chosen, others = [], []
        for i, s in enumerate(similarity.tolist()):
            if s > nearest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(nearest, among[i], out=nearest)
            else:
                others.append(i)
        return nodes[(chosen + others)[:most]]

    def attach(self, layer: int, node: int, other: int) -> None:
        links, degree = self.links[layer], self.degree[layer]
        d = degree[node]
        if d == links.shape[1]:
            near = np.append(links[node], other)
            similarity = self.vectors[near] @ self.vectors[node]
            order = np.argsort(-similarity, kind="stable")
            near = self.diverse(near[order], similarity[order], 2 * self.width if layer == 0 else self.width)
            d = len(near)
            links[node, :d] = near
        else:
            links[node, d] = other
            d += 1
        degree[node] = d

    def add(self, node: int) -> None:
        level, query = int(self.levels[node]), self.vectors[node]
        if self.entry < 0:
            self.entry = node
            return
        top = int(self.levels[self.entry])
        at = self.descend(query, min(top, level))
        for layer in range(min(top, level), -1, -1):
            at, similarity = self.search(query, at, self.beam, layer)
            chosen = self.diverse(at, similarity, self.width)
            self.links[layer][node, : len(chosen)] = chosen
            self.degree[layer][node] = len(chosen)
            for other in chosen.tolist():
                self.attach(layer, other, node)
        if level > top:
            self.entry = node

    def _reach(self, reached: np.ndarray, front: np.ndarray) -> None:
        links, degree = self.links[0], self.degree[0]
        columns = np.arange(links.shape[1])
        while len(front):
            reached[front] = True
            near = np.unique(links[front][columns < degree[front][:, None]])
            front = near[~reached[near]]

    def connect(self) -> None:
        """Every node can be reached from the entry in the lowest layer."""
        reached = np.zeros(len(self.vectors), bool)
        if len(reached):
            self._reach(reached, np.array([self.entry]))
        for node in np.flatnonzero(~reached).tolist():
            if reached[node]:
                continue
            near = self.search(self.vectors[node], self.descend(self.vectors[node], 0), self.beam, 0)[0]
            near = near[reached[near]]
            host = int(near[0]) if len(near) else self.entry
            d = min(int(self.degree[0][host]), self.links[0].shape[1] - 1)
            self.links[0][host, d] = node  # in place of its last neighbour if it is full
            self.degree[0][host] = d + 1
            self._reach(reached, np.array([node]))

    def within(self, query: np.ndarray, floor: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of similarity ``floor`` or more: a beam search, then all neighbours of what it found, and theirs."""
        entries = np.append(self.descend(query, 0), self.entry)
        nodes, similarity = self.search(query, entries, beam, 0)
        good = similarity >= floor
        nodes, similarity = nodes[good], similarity[good]
        found, known, front = [nodes], [similarity], nodes
        links, degree, columns = self.links[0], self.degree[0], np.arange(self.links[0].shape[1])
        self.turn += 1  # the search has seen nodes it did not spread from
        self.seen[nodes] = self.turn
        while len(front):
            near = np.unique(links[front][columns < degree[front][:, None]])
            near = near[self.seen[near] != self.turn]
            self.seen[near] = self.turn
            s = self.vectors[near] @ query
            good = s >= floor
            front = near[good]
            found.append(front)
            known.append(s[good])
        return np.concatenate(found), np.concatenate(known)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one in double precision, also where squares would overflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def links_between(a: Graph, b: Graph, same: bool, settings: Settings) -> tuple[np.ndarray, int, int, int]:
    """Which nodes of ``a`` are linked to which of ``b``; audited links, those of them that were found, and the beam."""
    found = np.zeros((len(a.vectors), len(b.vectors)), bool)
    floor, beam = settings.similarity - SLACK, settings.beam
    # stated sample: evenly spaced nodes, which are in the order of a hash
    sample = np.unique(np.linspace(0, len(a.vectors) - 1, min(settings.audited, len(a.vectors))).astype(int))
    exact = a.vectors[sample] @ b.vectors.T >= settings.similarity
    if same:
        exact[np.arange(len(sample)), sample] = False
    while True:
        close: list[tuple[int, int]] = []

        def mark(i: int, j: np.ndarray, s: np.ndarray, turned: bool) -> None:
            sure = j[s >= settings.similarity + SLACK]
            if turned:
                found[sure, i] = True
            else:
                found[i, sure] = True
            close.extend((int(x), i) if turned else (i, int(x)) for x in j[s < settings.similarity + SLACK])

        for i, query in enumerate(a.vectors):
            mark(i, *b.within(query, floor, beam), False)
        if not same:
            for j, query in enumerate(b.vectors):
                mark(j, *a.within(query, floor, beam), True)
        for i, j in close:
            found[i, j] = float(np.sum(a.vectors[i] * b.vectors[j])) >= settings.similarity
        if same:
            found |= found.T
            np.fill_diagonal(found, False)
        truth, hit = int(exact.sum()), int((exact & found[sample]).sum())
        if hit >= settings.recall * truth or beam >= max(found.shape):
            return found, truth, hit, beam
        beam *= 2


def weighted_counts(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.concatenate([found[k : k + 256] @ weights for k in range(0, len(found), 256)] or [np.zeros(0, np.int64)])


def roots(found: np.ndarray, same: bool) -> np.ndarray:
    """The least node of each node's component; nodes of the second shard are numbered after those of the first."""
    n, m = found.shape
    root = np.full(n if same else n + m, -1)

    def spread(front: np.ndarray) -> np.ndarray:
        out = np.zeros(len(root), bool)
        for part in np.array_split(front, len(front) // 256 + 1):
            if same:
                out |= found[part].any(0)
            else:
                out[n:] |= found[part[part < n]].any(0)
                out[:n] |= found[:, part[part >= n] - n].any(1)
        return out

    linked = found.any(1) if same else np.concatenate([found.any(1), found.any(0)])
    for start in np.flatnonzero(linked).tolist():
        if root[start] >= 0:
            continue
        front = np.array([start])
        while len(front):
            root[front] = start
            front = np.flatnonzero(spread(front) & (root < 0))
    return root


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def named(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, dim, vector and node: two hashes of label and vector; null for rows that link with nothing."""
    kind = dict(embeddings.dtypes)["embedding"]
    rows = checked(embeddings, "vec_id", "embedding", "label")
    if kind not in ("array<float>", "array<double>"):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    usual = rows.withColumn("usable", usable(F.col("embedding")) & F.col("label").isNotNull())
    vector = F.when(F.col("usable"), F.transform("embedding", lambda x: x + F.lit(0).cast("float")))  # -0 becomes 0
    marked = usual.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), vector.alias("vector"))
    both = [F.xxhash64("label", "vector"), F.xxhash64(F.lit("second"), "vector", "label")]
    name = F.concat(*[F.lpad(F.hex(x), 16, "0") for x in both])
    return marked.select("vec_id", "label", F.size("vector").alias("dim"), "vector", F.when(F.col("vector").isNotNull(), name).alias("node"))


def shard_index(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row per shard: the names of its nodes, how many rows each has, and the graph."""
    nodes = materialize(
        rows.where("node IS NOT NULL").groupBy("label", "dim", "node", "vector").agg(F.count("*").alias("copies")), "hnsw-nodes"
    )
    share = F.greatest(F.lit(1 / settings.shard_rows), F.col("dim") * (8 / settings.shard_bytes))
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        "label", "dim", F.ceil(F.col("n") * share).cast("int").alias("shards")
    )
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.expr("CAST(pmod(xxhash64(node), shards) AS int)"))
    ship(rows.sparkSession)
    label = rows.schema["label"].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        n, dim = group.num_rows, group.column("dim")[0].as_py()
        flat = group.column("vector").combine_chunks()
        vectors = unit(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim))
        names = group.column("node").to_pylist()
        chance = (np.array([int(x[16:], 16) for x in names], np.float64) + 0.5) * 2.0**-64
        levels = np.minimum(-np.log(chance) / np.log(settings.width), 8).astype(np.int64)
        graph = Graph.built(vectors, levels, settings.width, settings.build_beam)
        first = group.slice(0, 1)
        return pa.table(
            {c: first.column(c) for c in ("label", "dim", "shard", "shards")}
            | {"nodes": pa.array([names], pa.list_(pa.string())), "copies": pa.array([group.column("copies").to_pylist()], pa.list_(pa.int64())),
               "graph": pa.array([graph.to_bytes()], pa.binary())}
        )

    schema = f"label {label}, dim int, shard int, shards int, nodes array<string>, copies array<bigint>, graph binary"
    return materialize(dealt.groupBy("label", "dim", "shard").applyInArrow(build, schema), "hnsw-index")


PAIR_SCHEMA = "node string, links long, root string, audited long, hit long, beam int"


def shard_links(index: DataFrame, settings: Settings) -> DataFrame:
    """For each pair of shards a row per linked node (links, root) and one row with the audit (audited, hit, beam)."""
    ship(index.sparkSession)
    met = index.withColumn("other", F.explode(F.expr("sequence(0, shards - 1)"))).select(
        "label", "dim", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "nodes", "copies", "graph"
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        same = group.num_rows == 1
        graphs = [Graph.from_bytes(x.as_py()) for x in group.column("graph")]
        names = [x.as_py() for x in group.column("nodes")]
        copies = [np.array(x.as_py(), np.int64) for x in group.column("copies")]
        found, truth, hit, beam = links_between(graphs[0], graphs[-1], same, settings)
        root = roots(found, same)
        links = weighted_counts(found, copies[-1])
        if not same:
            links = np.concatenate([links, weighted_counts(found.T, copies[0])])
        every = names[0] if same else names[0] + names[1]
        at = np.flatnonzero(root >= 0).tolist()
        none = [None] * len(at)
        return pa.table(
            {
                "node": pa.array([every[i] for i in at] + [None], pa.string()),
                "links": pa.array([*links[at].tolist(), None], pa.int64()),
                "root": pa.array([every[root[i]] for i in at] + [None], pa.string()),
                "audited": pa.array([*none, truth], pa.int64()), "hit": pa.array([*none, hit], pa.int64()),
                "beam": pa.array([*none, beam], pa.int32()),
            }
        )

    return materialize(met.groupBy("label", "dim", "low", "high").applyInArrow(compare, PAIR_SCHEMA), "hnsw-links")


def audits(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """audited, hit and beam of every pair of shards."""
    found = shard_links(shard_index(materialize(named(embeddings), "hnsw-rows"), settings), settings)
    return found.where("node IS NULL").select("audited", "hit", "beam")


def near_duplicates(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors link if their labels and lengths are equal and their cosine is
    ``similarity`` or more; the component is the least vec_id that links reach.
    Rows that repeat are vectors of their own and link with each other.  Vectors
    that are null, empty, zero or hold null or non-finite components, and rows
    without a label, link with nothing.  A null vec_id is no least one; its row is
    kept if its component has no other id.  Ties do not matter, an empty table gives
    an empty result, further columns are not read.
    """
    rows = materialize(named(embeddings), "hnsw-rows")
    found = shard_links(shard_index(rows, settings), settings).where("node IS NOT NULL")
    labels = connected_components(found.where("node != root").select("node", "root"), "hnsw-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = materialize(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .join(links, "node", "left").join(labels, "node", "left")
        .select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")),
        "hnsw-counts",
    )
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    answers = nodes.join(least, "component").select("node", "n_links", "component_id")
    linked = rows.where("node IS NOT NULL").join(answers, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
