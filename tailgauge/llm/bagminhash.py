"""Near-duplicate documents by BagMinHash over weighted word shingles.

A document is a bag: each five-word shingle weighs as often as it occurs.  For
each shingle a Poisson process runs over its weight axis, cut at powers of two
(the levels of the discretised weights): points come in ascending time, each with
a place on the axis and a register, and count if the place lies under the
document's weight.  A level of width 2**k is one process of that rate, so a heavy
shingle costs a logarithm of its weight.  A register keeps its earliest point.
Two documents share a register's point with the probability of their weighted
Jaccard similarity, which makes the signature unbiased.  Times beyond the one at
which all registers are full cannot matter and are not generated.

Signatures are banded, documents that share a band are candidates, and the exact
multiset Jaccard similarity of the texts decides.  With the default bands a pair
at 0.8 is missed with a probability of about 3e-6.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import buffer_of, checked, per_batch, ship, text_key, unused
from .components import connected_components
from .words import mixed, span_hashes, shingles, word_spans


@dataclass(frozen=True)
class Bands:
    count: int = 24
    rows: int = 4
    width: int = 5
    similarity: float = 0.8

    @property
    def registers(self) -> int:
        return self.count * self.rows


def weighted(document: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) without repeats; at most 65,536 documents."""
    packed = np.sort((document.astype(np.uint64) << np.uint64(48)) | (shingle >> np.uint64(16)))
    if not len(packed):
        return document, shingle, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    weight = np.diff(np.append(first, len(packed)))
    kept = packed[first]
    return (kept >> np.uint64(48)).astype(np.int64), kept & np.uint64((1 << 48) - 1), weight


def signatures(document: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) hashes of the earliest points; rows without shingles hold zeros."""
    times = np.full(n * registers, np.inf)
    points = np.zeros(n * registers, np.uint64)
    total = np.bincount(document, weights=weight, minlength=n)
    until = registers * (np.log(registers) + 2.5) / np.maximum(total, 1)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(weight) else np.empty(0, np.int64)
    cell = np.repeat(np.arange(len(weight)), levels)
    level = np.arange(len(cell)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.maximum(low, 1).astype(float)
    whole = low + rate <= weight[cell]
    doc, seed = document[cell], mixed(shingle[cell] * np.uint64(64) + level.astype(np.uint64))
    over = weight[cell]
    time = np.zeros(len(cell))
    state = seed
    waiting = np.arange(len(cell))
    pending: list[np.ndarray] = []
    while True:
        while len(waiting):
            state_w = mixed(state[waiting] + np.uint64(0x9E3779B97F4A7C15))
            state[waiting] = state_w
            gap = -np.log(((state_w >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            t = time[waiting] + gap / rate[waiting]
            time[waiting] = t
            late = t > until[doc[waiting]]
            if late.any():
                pending.append(waiting[late])
            waiting, t, point = waiting[~late], t[~late], mixed(state_w[~late] ^ np.uint64(0xD1B54A32D192ED03))
            place = (point >> np.uint64(32)).astype(float) * 2.0**-32
            under = whole[waiting] | (low[waiting] + np.floor(place * rate[waiting]) < over[waiting])
            key = doc[waiting][under] * registers + ((point[under] & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            t, point = t[under], point[under]
            np.minimum.at(times, key, t)
            won = times[key] == t
            points[key[won]] = point[won]
        short = np.isinf(times.reshape(n, registers)).any(1) & (total > 0)
        if not short.any():
            return points.reshape(n, registers)
        until[short] *= 2
        waiting = np.concatenate(pending) if pending else np.empty(0, np.int64)
        again = short[doc[waiting]]
        pending, waiting = [waiting[~again]], waiting[again]
        # those whose next point is still late wait on; the others take it up where they stopped
        late = time[waiting] > until[doc[waiting]]
        pending.append(waiting[late])
        waiting = waiting[~late]
        key, t, point = _taken_up(waiting, time, state, doc, low, rate, whole, over, registers)
        np.minimum.at(times, key, t)
        won = times[key] == t
        points[key[won]] = point[won]


def _taken_up(waiting, time, state, doc, low, rate, whole, over, registers):
    """The points at which these processes had stopped."""
    point = mixed(state[waiting] ^ np.uint64(0xD1B54A32D192ED03))
    place = (point >> np.uint64(32)).astype(float) * 2.0**-32
    under = whole[waiting] | (low[waiting] + np.floor(place * rate[waiting]) < over[waiting])
    key = doc[waiting] * registers + ((point & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
    return key[under], time[waiting][under], point[under]


def bag(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of one text and their counts."""
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, counts = word_spans(data, offsets)
    return np.unique(shingles(span_hashes(data, starts, ends), counts, width)[1], return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset Jaccard similarity of two bags; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total else 0.0


def signed(docs: DataFrame, bands: Bands) -> DataFrame:
    """(doc_id, key, node, signature) of all rows.

    ``node`` names the words of a text (a 128-bit digest, case and white space
    ignored) and is null without words; ``key`` hashes the text itself.
    """

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = buffer_of(batch.column(1))
        starts, ends, counts = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        second = mixed(hashes + np.uint64(0x632BE59BD9B4E019))
        at = np.concatenate([[0], np.cumsum(counts)])
        nodes = [
            hashlib.blake2b(second[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if counts[i] else None
            for i in range(len(counts))
        ]
        documents, found = shingles(hashes, counts, bands.width)
        points = signatures(*weighted(documents, found), len(counts), bands.registers)
        marks = list((points >> np.uint64(32)).astype(np.uint32).view(np.int32))
        return {"doc_id": batch.column(0), "key": batch.column(2), "node": nodes, "signature": marks}

    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", text_key("text").alias("key"))
    return per_batch(rows, "text", run, "doc_id long, key long, node binary, signature array<int>")


def band_rows(nodes: DataFrame, bands: Bands) -> DataFrame:
    """(band, node): one row for each band of each signature."""
    values = [
        F.xxhash64(F.lit(k), *[F.col("signature")[k * bands.rows + i] for i in range(bands.rows)])
        for k in range(bands.count)
    ]
    return nodes.select("node", F.explode(F.array(*values)).alias("band"))


def node_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text), once each, for nodes whose ``row`` names the doc_id and key of one of their rows."""
    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", text_key("text").alias("key"))
    wanted = nodes.select("node", F.col("row.doc_id").alias("id"), F.col("row.key").alias("k"))
    found = rows.join(wanted, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return found.select("node", "text").dropDuplicates(["node"])


def similar_pairs(pairs: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts reach the similarity; ``texts`` has node and text once each."""

    def run(batch: pa.RecordBatch) -> dict:
        kept: dict[bytes, tuple] = {}
        left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"a": [], "b": []}
        for i, (x, y) in enumerate(zip(left, right)):
            bags = []
            for name, column in ((x, 2), (y, 3)):
                found = kept.get(name)
                if found is None:
                    if len(kept) >= 64:
                        kept.clear()
                    found = kept[name] = bag(batch.column(column)[i].as_py().encode(), bands.width)
                bags.append(found)
            if similarity(*bags) >= bands.similarity:
                out["a"].append(x)
                out["b"].append(y)
        return out

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return per_batch(both, "text_a", run, "a binary, b binary")


def occurrences(text: bytes, width: int) -> np.ndarray:
    """A hash for each occurrence of each shingle, so that a bag is a set."""
    found, times = bag(text, width)
    repeated = np.repeat(found, times)
    number = np.arange(len(repeated)) - np.repeat(np.cumsum(times) - times, times)
    return mixed(repeated + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """(len(a), len(b)) sizes of the intersections of sets; products of 0/1 matrices, some columns at a time."""
    sets = a + b
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.bincount(number, weights=owner < len(a), minlength=len(values))
    useful = (both > 0) & (both < times)
    number, owner = (np.cumsum(useful) - 1)[number[useful[number]]], owner[useful[number]]
    out = np.zeros((len(a), len(b)), np.float32)
    by = np.argsort(number, kind="stable")
    number, owner = number[by], owner[by]
    for low in range(0, int(useful.sum()), columns):
        part = slice(*np.searchsorted(number, [low, low + columns]))
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[part], number[part] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def crowded_links(members: DataFrame, texts: DataFrame, labels: DataFrame, bands: Bands, chunk: int = 256) -> DataFrame:
    """Links between nodes of one band that the comparison with its least node left in different components.

    The nodes outside the band's largest component are compared with all nodes of
    the band, in squares of ``chunk`` by ``chunk``: a task multiplies the 0/1
    matrices of a square, so pairs are never rows, and returns the links that join
    the square's components, without those that close a circle.
    """
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("band", "component").count()
    ranked = parts.groupBy("band").agg(
        F.max(F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), F.count("*").alias("components")
    ).where("components > 1")
    ranked = ranked.select("band", "n", F.col("main.component").alias("main"), (F.col("n") - F.col("main.count")).alias("outside"))
    rest = named.join(ranked, "band")
    chunks = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), chunks(n)).cast("int")
    columns = ["band", "node", "component"]
    asked = rest.where("component != main").select(
        *columns, own("outside").alias("x"), F.explode(F.sequence(F.lit(0), chunks("n") - 1)).alias("y"), F.lit(True).alias("asks")
    )
    met = rest.select(
        *columns, F.explode(F.sequence(F.lit(0), chunks("outside") - 1)).alias("x"), own("n").alias("y"), F.lit(False).alias("asks")
    )
    squares = asked.unionByName(met).join(texts, "node")
    ship(members.sparkSession)

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        nodes, component = table.column("node").to_pylist(), table.column("component").to_pylist()
        sets = [occurrences(x.encode(), bands.width) for x in table.column("text").to_pylist()]
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: dict[tuple, tuple] = {}
        if len(a) and len(b):
            shared = shared_counts([sets[i] for i in a], [sets[i] for i in b])
            sizes = np.array([len(x) for x in sets])
            union = sizes[a][:, None] + sizes[b][None] - shared
            part: dict[bytes, bytes] = {}
            for i, j in zip(*np.nonzero(shared.astype(float) / union >= bands.similarity)):
                x, y = component[a[i]], component[b[j]]
                while x in part:
                    x = part[x]
                while y in part:
                    y = part[y]
                # links that close a circle add nothing
                if x != y:
                    part[max(x, y)] = min(x, y)
                    found[x, y] = nodes[a[i]], nodes[b[j]]
        links = list(found.values())
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())}
        )

    return squares.groupBy("band", "x", "y").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """(doc_id, class_id, class_size) of every row: the classes are the components of the similar pairs.

    ``class_id`` is the least doc_id of the class and ``class_size`` its rows.
    Texts of the same words are one node, so copies are never compared.  In each
    band the other nodes are first compared with the least one; nodes of different
    components that still share a band are then compared square by square.  Null texts and texts without
    words are classes of their own.  Rows that repeat count as copies; ties do not
    arise; an empty table gives an empty result.
    """
    named, alone = _classes(docs, bands)
    classes = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.join(classes, "class").select("doc_id", "class_id", "class_size").unionByName(alone)


def _classes(docs: DataFrame, bands: Bands) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, class) of the rows with words, (doc_id, key) of the others."""
    marked = materialize(signed(docs, bands), "bag-signed")
    nodes = materialize(
        marked.where("node IS NOT NULL").groupBy("node").agg(
            F.first("signature").alias("signature"), F.min(F.struct("doc_id", "key")).alias("row")
        ),
        "bag-nodes",
    )
    rows = band_rows(nodes, bands)
    shared = rows.groupBy("band").count().where("count > 1").select("band")
    members = materialize(rows.join(shared, "band"), "bag-bands")
    texts = materialize(
        node_texts(docs, nodes.join(members.select("node").distinct(), "node")), "bag-texts"
    )
    leaders = members.groupBy("band").agg(F.min("node").alias("a"))
    first = members.join(leaders, "band").where("node != a").select("a", F.col("node").alias("b")).distinct()
    links = materialize(similar_pairs(first, texts, bands), "bag-links")
    labels = connected_components(links)
    more = materialize(crowded_links(members, texts, labels, bands), "bag-links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    named = marked.where("node IS NOT NULL").select("doc_id", "key", "node").join(labels, "node", "left")
    named = named.select("doc_id", "key", F.coalesce("component", "node").alias("class"))
    return named, marked.where("node IS NULL").select("doc_id", "key")


def keep_one(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of each class, the one of the least doc_id (then of the least text hash), all columns unchanged.

    A document is known by its id and its text: of rows that share an id but not a
    class, each class keeps its own.  Rows that repeat id and text are kept once;
    rows with a null doc_id or without words are kept.
    """
    named, _ = _classes(docs, bands)
    numbered = materialize(named.where("doc_id IS NOT NULL"), "bag-classes")
    row = F.struct("doc_id", "key")
    least = numbered.groupBy("class").agg(F.min(row).alias("least"))
    others = numbered.join(least, "class").where(row != F.col("least")).select("doc_id", "key").distinct()
    copies = numbered.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    key, gone_id, gone_key = (unused(x, docs) for x in ("text_key", "gone_id", "gone_key"))
    keyed = docs.withColumn(key, text_key("text"))

    def of(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
        names = names.select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key))
        return rows.join(names, (rows["doc_id"] == names[gone_id]) & (rows[key] == names[gone_key]), how)

    kept = of(keyed, others, "left_anti")
    if copies.isEmpty():
        return kept.drop(key)
    once, many = of(kept, copies, "left_anti"), of(kept, copies, "left_semi")
    return once.unionByName(many.dropDuplicates(["doc_id", key])).drop(key)
