"""Exact removal of long repeated strings with run-length compressed indexes.

Two equal windows of ``length`` bytes have equal bytes everywhere, so also the
same least ``gram`` (by hash) at the same place.  Neighbouring windows with one
such gram, and with it in the same half, form a piece; the bytes that all windows
of that half have in common are the piece's anchor.  There is a piece for about
each sixty bytes.  Anchors that occur once cannot repeat anything.  Pieces that occur twice as a whole are repeated
throughout.  What is left are pieces that share an anchor and differ somewhere,
each different piece once; they are dealt by anchor into blocks of bounded size.

A block gets a run-length index: the Burrows-Wheeler transform of its pieces
keeps, at the ends of its runs only, the text position and the length of the
match with the neighbouring suffix.  Inside a run that length falls by one with
each step along the text, so streaming a piece through the samples gives the
length of the longest other match at every position, and a window repeats where
it reaches ``length``.  In repetitive text the runs are few.

An anchor with very many different pieces (a passage in very many documents)
would make a large block.  Its windows are compared by hash instead, in an
ordinary aggregation that combines in every task first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import buffer_of, checked, per_batch, ship, text_key
from .words import BASE, INVERSE, mixed, powers

BLOCK = 1 << 20


@dataclass(frozen=True)
class Windows:
    """``block_bytes``: aim for an index; ``most_pieces``: of one anchor in an index, more are compared by hash."""

    length: int = 200
    gram: int = 24
    parts: int = 2
    block_bytes: int = 1 << 20
    most_pieces: int = 1500

    @property
    def reach(self) -> int:
        return -(-(self.length - self.gram + 1) // self.parts)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by minima from both ends of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def pieces_of(data: np.ndarray, offsets: np.ndarray, w: Windows) -> dict[str, np.ndarray]:
    """Text number, start in the text, number of windows, anchor and content hash of every piece."""
    found: dict[str, list] = {k: [] for k in ("text", "start", "windows", "anchor", "content")}
    for at in range(0, max(1, len(data) - w.length + 1), BLOCK):
        part = data[at : at + BLOCK + w.length - 1]
        if len(part) < w.length:
            break
        n = len(part) - w.length + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
        inverse = powers(INVERSE, len(part) + 1)
        grams = mixed((sums[w.gram :] - sums[: -w.gram]) * inverse[: len(part) - w.gram + 1])
        order = (grams & ~np.uint64((1 << 23) - 1)) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_minimum(order, w.length - w.gram + 1)
        text = np.searchsorted(offsets, np.arange(at, at + n), "right") - 1 if len(offsets) < 3 else np.repeat(
            np.arange(len(offsets) - 1), np.diff(np.clip(offsets, at, at + n))
        )
        valid = np.arange(at, at + n) + w.length <= offsets[text + 1]
        lowest = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
        part_of = (lowest - np.arange(n)) // w.reach  # which side of the gram the windows reach to
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (part_of[1:] != part_of[:-1])
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        count = np.add.reduceat(valid.astype(np.int64), starts)
        ends = starts + count + w.length - 1
        content = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        core = lowest[starts] - part_of[starts] * w.reach  # what all windows of the part have in common
        last = core + w.length - w.reach + 1
        anchor = mixed((sums[last] - sums[core]) * inverse[core] + part_of[starts].astype(np.uint64))
        found["text"].append(text[starts])
        found["start"].append(starts + at - offsets[text[starts]])
        found["windows"].append(count)
        found["anchor"].append(anchor.view(np.int64))
        found["content"].append(content.view(np.int64))
    return {k: np.concatenate(x) if x else np.empty(0, np.int64) for k, x in found.items()}


def sorted_with_groups(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their keys, all below ``most``, and the number of each one's group of equals.

    Where key and position fit one word that word is sorted, which is much
    faster than sorting positions.
    """
    n = len(key)
    bits = int(n).bit_length()
    if most < 1 << (64 - bits):
        packed = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        ordered = packed >> np.uint64(bits)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    groups = np.zeros(n, np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=groups[1:])
    return order, groups


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of several strings with sampled run ends."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(x) for x in strings])
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends = np.repeat(self.starts + lengths, lengths + 1)
        n = len(self.ends)
        symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        symbols[self.starts + lengths] = 0
        order, self._ranks = self._sorted(symbols, 257)
        before = symbols[order - 1]
        before[order == 0] = -1  # nothing stands before the first
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        matched = self._matched(order[change - 1], order[change], symbols)
        self.runs = len(change) + 1
        # the first suffix of each run with its match upwards, the last one with its match downwards
        self.head = self._sample(n, np.append(order[change], order[0]), np.append(matched, 0))
        self.tail = self._sample(n, np.append(order[change - 1], order[-1]), np.append(matched, 0))
        del self._ranks

    @staticmethod
    def _sorted(symbols: np.ndarray, size: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order by doubling, and the ranks of all substrings of each doubled length."""
        n = len(symbols)
        key, width, most = symbols, 1, size
        while width < 4 and most * most < 1 << 42:
            key = key * most + np.append(key[width:], np.zeros(min(width, n), np.int64))[:n]
            width, most = 2 * width, most * most
        ranks = []
        while True:
            order, fresh = sorted_with_groups(key, most)
            rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
            rank[order] = fresh
            ranks.append((width, rank))
            if fresh[-1] == n - 1:
                return order, ranks
            key, most = rank.astype(np.int64) * (n + 1), n * (n + 1) + n + 1
            key[: n - width] += rank[width:] + 1
            width *= 2

    def _matched(self, a: np.ndarray, b: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at ``a`` and ``b``."""
        n = len(symbols)
        found = np.zeros(len(a), np.int64)
        smallest = self._ranks[0][0]
        for width, rank in self._ranks[::-1] + [(k, None) for k in (2, 1) if k < smallest]:
            x, y = np.minimum(a + found, n - 1), np.minimum(b + found, n - 1)
            if rank is not None:
                same = rank[x] == rank[y]
            else:
                same = np.ones(len(a), bool)
                for k in range(width):
                    same &= symbols[np.minimum(x + k, n - 1)] == symbols[np.minimum(y + k, n - 1)]
            found += np.where(same & (a + found < n) & (b + found < n), width, 0)
        return found

    @staticmethod
    def _sample(n: int, position: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(position)
        return position[order], value[order]

    def statistics(self) -> np.ndarray:
        """For each position of the strings, the longest match that also starts elsewhere.

        String ``i`` begins at ``starts[i]``; matches end with their string.
        """
        n = len(self.ends)
        best = np.zeros(n, np.int64)
        for at, value in (self.head, self.tail):
            sample = np.zeros(n, np.int64)
            sample[at] = np.arange(len(at))
            np.maximum.accumulate(sample, out=sample)
            best = np.maximum(best, value[sample] - (np.arange(n) - at[sample]))
        return np.minimum(best, self.ends - np.arange(n))


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed): texts compressed for the shuffle; null is empty."""

    def pack(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=1).compress
        return {
            "doc_id": batch.column(0),
            "key": batch.column(2),
            "packed": [press((x or "").encode()) for x in batch.column(1).to_pylist()],
        }

    return per_batch(keyed(docs), "text", pack, "doc_id long, key long, packed binary")


def keyed(docs: DataFrame) -> DataFrame:
    return checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", text_key("text").alias("key"))


def by_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the content of a row, so that repeated ids and null ids do not mix texts."""
    renamed = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key")
    joined = left.join(renamed, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), how)
    return joined.drop("_id", "_key")


def all_pieces(docs: DataFrame, w: Windows) -> DataFrame:
    def cut(batch: pa.RecordBatch) -> dict:
        found = pieces_of(*buffer_of(batch.column(1)), w)
        at = pa.array(found.pop("text"))
        return found | {"doc_id": batch.column(0).take(at), "key": batch.column(2).take(at)}

    schema = "doc_id long, key long, anchor long, content long, start int, windows int"
    return per_batch(keyed(docs), "text", cut, schema)


def piece_bytes(docs: DataFrame, wanted: DataFrame, w: Windows) -> DataFrame:
    """The rows of ``wanted`` (doc_id, key, anchor, start, windows, copies, many) with the bytes of their pieces."""
    lists = wanted.groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("anchor", "start", "windows", "copies", "many")).alias("pieces")
    )

    def cut(batch: pa.RecordBatch) -> dict:
        names = ("doc_id", "key", "anchor", "start", "windows", "copies", "many")
        out: dict[str, list] = {k: [] for k in (*names, "bytes")}
        open_up = zstandard.ZstdDecompressor().decompress
        for row in batch.to_pylist():
            text = open_up(row["packed"])
            for x in row["pieces"]:
                for k in names[:2]:
                    out[k].append(row[k])
                for k in names[2:]:
                    out[k].append(x[k])
                out["bytes"].append(text[x["start"] : x["start"] + x["windows"] + w.length - 1])
        return out

    schema = "doc_id long, key long, anchor long, start int, windows int, copies long, many boolean, bytes binary"
    return per_batch(by_document(packed_texts(docs), lists, "inner"), "packed", cut, schema)


def indexed_spans(pieces: DataFrame, w: Windows, blocks: int) -> DataFrame:
    """Repeated spans of the pieces that occur once, from one index for each block of anchors."""
    ship(pieces.sparkSession)

    def spans(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        strings = rows.column("bytes").to_pylist()
        index = RunLengthIndex(strings)
        start, windows = rows.column("start").to_numpy(), rows.column("windows").to_numpy()
        alone = rows.column("copies").to_numpy() == 1
        edges = np.zeros(len(index.ends) + 1, np.int64)
        np.add.at(edges, index.starts[alone], 1)
        np.add.at(edges, index.starts[alone] + windows[alone], -1)
        first, last = runs_of((np.cumsum(edges[:-1]) > 0) & (index.statistics() >= w.length))
        at = np.searchsorted(index.starts, first, "right") - 1
        low = start[at] + first - index.starts[at]
        high = start[at] + last - index.starts[at] - 1 + w.length
        at = pa.array(at, pa.int64())
        return pa.table(
            {
                "doc_id": rows.column("doc_id").take(at), "key": rows.column("key").take(at),
                "low": pa.array(low, pa.int32()), "high": pa.array(high, pa.int32()),
            }
        )

    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block")
    return pieces.withColumn("block", block).groupBy("block").applyInArrow(
        spans, "doc_id long, key long, low int, high int"
    )


def hashed_spans(pieces: DataFrame, w: Windows) -> DataFrame:
    """Repeated spans of the pieces of frequent anchors: windows with equal hashes are counted."""

    def windows(batch: pa.RecordBatch) -> dict:
        at, place, first, second = [], [], [], []
        starts, counts = batch.column("start").to_numpy(), batch.column("windows").to_numpy()
        for i, text in enumerate(batch.column("bytes").to_pylist()):
            n = counts[i]
            values = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(mixed(values) * powers(BASE, len(values)), out=sums[1:])
            spread = (sums[w.length : w.length + n] - sums[:n]) * powers(INVERSE, n)
            np.cumsum(values * powers(INVERSE, len(values)), out=sums[1:])
            other = (sums[w.length : w.length + n] - sums[:n]) * powers(BASE, n)
            at.append(np.full(n, i))
            place.append(starts[i] + np.arange(n))
            first.append(mixed(spread))
            second.append(mixed(other))
        at = pa.array(np.concatenate(at))
        return {
            "doc_id": batch.column("doc_id").take(at), "key": batch.column("key").take(at),
            "low": np.concatenate(place), "first": np.concatenate(first).view(np.int64),
            "second": np.concatenate(second).view(np.int64),
        }

    rows = per_batch(pieces, "bytes", windows, "doc_id long, key long, low int, first long, second long", most=1 << 19)
    repeated = rows.groupBy("first", "second").count().where("count > 1").select("first", "second")
    return rows.join(repeated, ["first", "second"]).select("doc_id", "key", "low", (F.col("low") + w.length).alias("high"))


def repeated_spans(docs: DataFrame, w: Windows = Windows()) -> DataFrame:
    """(doc_id, key, spans): the ``low`` and ``high`` byte offsets of covering spans for each text that repeats something."""
    pieces = materialize(all_pieces(docs, w), "rl-pieces")
    anchors = pieces.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most")
    )
    anchors = anchors.where("n > 1").select("anchor", (F.col("least") < F.col("most")).alias("differ"))
    anchors = materialize(anchors, "rl-anchors")  # read by the join on its own, a frequent anchor's rows can be split
    shared = materialize(pieces.join(anchors, "anchor"), "rl-shared")
    kinds = shared.where("differ").groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "key", "start", "windows")).alias("one")
    )
    kinds = materialize(kinds, "rl-kinds")
    open_anchors = kinds.groupBy("anchor").agg(F.min("copies").alias("fewest"), F.count("*").alias("kinds"))
    open_anchors = open_anchors.where("fewest = 1").select("anchor", (F.col("kinds") > w.most_pieces).alias("many"))
    wanted = kinds.join(open_anchors, "anchor").select("anchor", "copies", "many", "one.*")
    cut = materialize(piece_bytes(docs, wanted, w), "rl-bytes")
    size = cut.where("NOT many").agg(F.sum(F.length("bytes"))).first()[0] or 0
    span = ["doc_id", "key", F.col("start").alias("low"), (F.col("start") + F.col("windows") + w.length - 1).alias("high")]
    same = shared.where("NOT differ").select(*span)
    copied = shared.where("differ").join(kinds.where("copies > 1").select("anchor", "content"), ["anchor", "content"])
    found = same.unionByName(copied.select(*span))
    if size:
        found = found.unionByName(indexed_spans(cut.where("NOT many"), w, -(-size // w.block_bytes)))
    found = found.unionByName(hashed_spans(cut.where("many"), w))
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Flags of the bytes that the spans cover."""
    edges = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edges, [x["low"] for x in spans], 1)
        np.add.at(edges, [x["high"] for x in spans], -1)
    return np.cumsum(edges[:-1]) > 0


def cut_texts(docs: DataFrame, w: Windows = Windows()) -> DataFrame:
    """(doc_id, key, kept, n_bytes, n_removed, n_spans): every row with the bytes left of its text.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere
    is removed, in all its places, judged on the input.  Null texts are empty;
    shorter texts are left whole; rows that repeat remove each other; matches do
    not cross texts.
    """

    def cut(batch: pa.RecordBatch) -> dict:
        open_up = zstandard.ZstdDecompressor().decompress
        out: dict[str, list] = {k: [] for k in ("kept", "n_bytes", "n_removed", "n_spans")}
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist()):
            text = np.frombuffer(open_up(packed), np.uint8)
            gone = covered(len(text), spans)
            out["kept"].append(text[~gone].tobytes())
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(len(runs_of(gone)[0]))
        return out | {"doc_id": batch.column("doc_id"), "key": batch.column("key")}

    joined = by_document(packed_texts(docs), repeated_spans(docs, w), "left")
    schema = "doc_id long, key long, kept binary, n_bytes long, n_removed long, n_spans long"
    return per_batch(joined, "packed", cut, schema)


def removal_report(docs: DataFrame, w: Windows = Windows()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes left, for every row."""
    return cut_texts(docs, w).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, w: Windows = Windows()) -> DataFrame:
    """All rows and columns, with the repeated bytes gone from ``text``.

    A character of which bytes are removed goes as a whole, ``n_chars`` is counted
    anew where it is present, and texts without repeats keep null or their value.
    """
    spans = repeated_spans(docs, w).select(
        F.col("doc_id").alias("_span_id"), F.col("key").alias("_span_key"), F.col("spans").alias("_spans")
    )
    joined = docs.join(
        spans, (text_key("text") == F.col("_span_key")) & docs["doc_id"].eqNullSafe(F.col("_span_id")), "left"
    ).select(*[docs[c] for c in docs.columns], "_spans")
    at, marks = docs.columns.index("text"), len(docs.columns)
    ship(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(batch.column(marks).to_pylist()):
                if spans:
                    text = np.frombuffer(texts[i].encode(), np.uint8)
                    texts[i] = text[~covered(len(text), spans)].tobytes().decode(errors="ignore")
            columns = batch.columns[:marks]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:marks])

    out = joined.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
