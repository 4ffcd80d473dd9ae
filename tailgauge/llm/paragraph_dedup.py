"""Substring dedup by paragraph MinHash banding.

A paragraph is a line with a word.  Equal paragraphs (case and white space aside)
are one node.  Similarity is that of multisets: each node's five-word shingles,
every occurrence by its number, give a MinHash signature by one permutation with
optimal densification; 14 bands of 3 registers are tuned for
recall: a pair at a similarity of 0.8 is missed with a probability of about 4e-5.  Paragraphs that collide are compared: with the band's least one first, then
square by square where components are left that share a band, always by exact
multiset Jaccard similarity of the shingles.  Removals are decided by component: the
paragraph that comes first, by doc_id and line, stays, every other one goes.

Passages that repeat inside longer lines, or across line ends, have no line of their
own.  If asked, the words of a whole document are also cut where the hash of two
neighbouring words is the least of its surroundings, so that equal passages are cut
alike whatever stands around them.  Of equal pieces the first stays; the others go
if a run of them is long enough.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bagminhash import Bands, crowded_links, similar_pairs
from .columns import buffer_of, checked, per_batch, text_key
from .components import connected_components
from .words import BASE, INVERSE, mixed, powers, shingles, span_hashes, word_spans


@dataclass(frozen=True)
class Paragraphs:
    """Shorter paragraphs than ``least_words`` are compared by equality alone, those than ``least_removed`` stay.

    ``reach``: a piece begins at the least hash among so many words to either side; 0 cuts no pieces.  ``least_run``:
    words of a run of pieces that goes.
    """

    least_words: int = 5
    bands: Bands = Bands(count=14, rows=3)
    least_removed: int = 0
    reach: int = 0
    least_run: int = 16


#: Whole lines of 16 words or more, and passages of 16 or more inside them or across their ends.
PASSAGES = Paragraphs(least_removed=16, reach=6)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of every line; line ends belong to no line."""
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    starts, ends = cuts[:-1], cuts[1:].copy()
    if len(starts):
        ends -= data[ends - 1] == 10
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def numbered(document: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """A hash of each shingle and of which of its occurrences in the document it is, so that a bag is a set."""
    key = mixed(shingle + mixed(document.astype(np.uint64)))
    by = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]])[: len(key)])
    number = np.empty(len(key), np.uint64)
    number[by] = np.arange(len(key)) - np.repeat(begin, np.diff(begin, append=len(key)))
    return mixed(shingle + number * np.uint64(0x9E3779B97F4A7C15))


def minhash(document: np.ndarray, shingle: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) least hashes by one permutation; empty registers borrow from one that a hash names."""
    mixed_up = mixed(shingle)
    register = (mixed_up & np.uint64(0xFFFFFFFF)) % np.uint64(registers)
    out = np.full(n * registers, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, document * registers + register.astype(np.int64), mixed_up)
    out = out.reshape(n, registers)
    empty = out == np.iinfo(np.uint64).max
    owned = ~empty.all(1)
    filled, attempt = out.copy(), 0
    while (lacking := empty & owned[:, None]).any():
        attempt += 1
        row, column = np.nonzero(lacking)
        source = (mixed((column + registers * attempt).astype(np.uint64)) % np.uint64(registers)).astype(np.int64)
        value = out[row, source]
        got = value != np.iinfo(np.uint64).max
        filled[row[got], column[got]] = mixed(value[got] + np.uint64(attempt))
        empty[row[got], column[got]] = False
    return filled


def band_hashes(points: np.ndarray, bands: Bands) -> np.ndarray:
    """(n, bands) hashes of the registers of each band and its number."""
    out = np.tile(np.arange(bands.count, dtype=np.uint64), (len(points), 1))
    for k in range(bands.rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + points[:, k :: bands.rows])
    return out


def paragraphs(docs: DataFrame, p: Paragraphs) -> DataFrame:
    """(doc_id, key, line, words, node, bands) of every paragraph.

    ``node`` is an 80-bit digest of the words; there are no bands under ``least_words``, and neither under ``least_removed``.
    """
    least = max(p.least_words, p.least_removed)

    def cut(batch: pa.RecordBatch) -> dict:
        data, offsets = buffer_of(batch.column(1))
        text, starts, ends = lines_of(data, offsets)
        line = np.arange(len(text)) - np.searchsorted(text, text)
        cuts = np.append(starts, len(data))
        word_starts, word_ends, counts = word_spans(data, cuts)
        hashes = span_hashes(data, word_starts, word_ends)
        second = mixed(hashes + np.uint64(0x632BE59BD9B4E019))
        at = np.concatenate([[0], np.cumsum(counts)])
        # shingles of the lines that have bands
        banded = np.flatnonzero(counts >= least)
        document, found = shingles(hashes[np.repeat(counts >= least, counts)], counts[banded], p.bands.width)
        points = minhash(document, numbered(document, found), len(banded), p.bands.registers)
        marks = dict(zip(banded.tolist(), band_hashes(points, p.bands).view(np.int64)))
        kept = np.flatnonzero(counts > 0)
        take = pa.array(text[kept])
        return {
            "doc_id": batch.column(0).take(take), "key": batch.column(2).take(take), "line": line[kept],
            "words": counts[kept],
            "node": [
                hashlib.blake2b(second[at[i] : at[i + 1]].tobytes(), digest_size=10).digest() if n >= p.least_removed else None
                for i, n in zip(kept.tolist(), counts[kept].tolist())
            ],
            "bands": [marks.get(i) for i in kept.tolist()],
        }

    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", text_key("text").alias("key"))
    schema = "doc_id long, key long, line int, words int, node binary, bands array<long>"
    return per_batch(rows, "text", cut, schema, most=1 << 20)


def line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the paragraphs that (node, doc_id, key, line) rows name."""
    from .run_length_dedup import by_document, keyed

    lists = wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("line", "node")).alias("lines"))
    joined = by_document(keyed(docs), lists, "inner")
    picked = joined.select(F.split("text", "\n").alias("all"), F.explode("lines").alias("one"))
    return picked.select("one.node", F.get("all", F.col("one.line")).alias("text")).dropDuplicates(["node"])


def paragraph_classes(docs: DataFrame, p: Paragraphs = Paragraphs()) -> DataFrame:
    """(doc_id, key, line, words, kept) of every paragraph; all but the first of each component are not kept.

    Null and empty texts have none.  Rows that repeat are copies: their
    paragraphs tie in doc_id and line and go by the same rule, so of fully equal
    rows one is kept by :func:`without_paragraphs`.
    """
    cut = materialize(paragraphs(docs, p), "paragraph-cut")
    nodes = cut.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "line", "key")).alias("first"), F.count("*").alias("n"))
    rows = cut.where("bands IS NOT NULL").select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").count().where("count > 1").select("band")
    # a band that only copies of one paragraph share has one row left
    members = rows.join(shared, "band").distinct()
    members = materialize(members, "paragraph-bands")
    met = nodes.join(members.select("node").distinct(), "node").select("node", "first.*")
    texts = materialize(line_texts(docs, met), "paragraph-texts")
    leaders = members.groupBy("band").agg(F.min("node").alias("a"))
    first = members.join(leaders, "band").where("node != a").select("a", F.col("node").alias("b")).distinct()
    links = materialize(similar_pairs(first, texts, p.bands), "paragraph-links")
    labels = connected_components(links)
    more = materialize(crowded_links(members, texts, labels, p.bands), "paragraph-links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    named = nodes.join(labels, "node", "left").select("node", "first", "n", F.coalesce("component", "node").alias("class"))
    # the first paragraph of each class; classes of one single paragraph have nothing to remove
    heads = named.groupBy("class").agg(F.min("first").alias("head"), F.sum("n").alias("size")).where("size > 1")
    crowd = materialize(named.join(heads, "class").select("node", "head"), "paragraph-heads")
    found = cut.drop("bands").join(crowd, "node", "left")
    own = F.struct("doc_id", "line", "key")
    return found.select("doc_id", "key", "line", "words", (F.col("head").isNull() | (F.col("head") == own)).alias("kept"))


def piece_starts(hashes: np.ndarray, counts: np.ndarray, reach: int) -> np.ndarray:
    """Words at which a piece begins: the first of each text, and where the hash of two words is the least within ``reach``."""
    n = len(hashes)
    pairs = np.zeros(n, np.uint64)
    if n > 1:
        pairs[:-1] = mixed(mixed(hashes[:-1]) * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    # the last word of a text has no pair; texts are kept apart by ``reach`` places
    last = first + counts - 1
    pairs[last[counts > 0]] = np.iinfo(np.uint64).max
    at = np.arange(n) + (text + 1) * reach
    spread = np.full(n + (len(counts) + 1) * reach, np.iinfo(np.uint64).max, np.uint64)
    spread[at] = pairs
    least, width = spread, 1
    # least of 2 * reach + 1 places, by doubling
    while width < 2 * reach + 1:
        step = min(width, 2 * reach + 1 - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    begins = pairs == least[at - reach]
    begins[last[counts > 0]] = False
    begins[first[counts > 0]] = True
    return np.flatnonzero(begins)


def pieces(docs: DataFrame, p: Paragraphs) -> DataFrame:
    """(doc_id, key, piece, words, node): all pieces of every text; ``node`` is a 64-bit hash of the words."""

    def cut(batch: pa.RecordBatch) -> dict:
        data, offsets = buffer_of(batch.column(1))
        starts, ends, counts = word_spans(data, offsets)
        hashes = span_hashes(data, starts, ends)
        begin = piece_starts(hashes, counts, p.reach)
        words = np.diff(begin, append=len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
        node = mixed((sums[begin + words] - sums[begin]) * powers(INVERSE, len(hashes) + 1)[begin] + words.astype(np.uint64))
        text = np.repeat(np.arange(len(counts)), counts)[begin]
        take = pa.array(text)
        return {
            "doc_id": batch.column(0).take(take), "key": batch.column(2).take(take),
            "piece": np.arange(len(begin)) - np.searchsorted(text, text), "words": words, "node": node.view(np.int64),
        }

    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", text_key("text").alias("key"))
    return per_batch(rows, "text", cut, "doc_id long, key long, piece int, words int, node long", most=1 << 20)


def repeated_passages(docs: DataFrame, p: Paragraphs) -> DataFrame:
    """(doc_id, key, n_passages, passage_words) of the texts that lose passages: runs of pieces that came before."""
    cut = pieces(docs, p)
    own = F.struct("doc_id", "piece", "key")
    firsts = cut.groupBy("node").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # fully equal rows are one document
    gone = cut.join(firsts, "node").where(own != F.col("first")).groupBy("doc_id", "key", "piece").agg(
        F.first("words").alias("words")
    )
    run = F.col("piece") - F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("piece"))
    found = gone.withColumn("run", run).groupBy("doc_id", "key", "run").agg(F.sum("words").alias("words"))
    return found.where(F.col("words") >= p.least_run).groupBy("doc_id", "key").agg(
        F.count("*").alias("n_passages"), F.sum("words").cast("long").alias("passage_words")
    )


def removal_report(docs: DataFrame, p: Paragraphs = Paragraphs()) -> DataFrame:
    """doc_id, n_paragraphs, n_removed, n_words, removed_words and the removed line numbers, for every row's content.

    Rows of one doc_id and text are one document here; those without paragraphs
    count none.  With ``reach``, ``n_removed`` also counts the passages that go, and n_passages and passage_words follow;
    a passage may lie in a line that goes.
    """
    found = paragraph_classes(docs, p).dropDuplicates(["doc_id", "key", "line"])
    gone = F.when(~F.col("kept"), F.col("line"))
    counts = found.groupBy("doc_id", "key").agg(
        F.count("*").alias("n_paragraphs"), F.count(gone).alias("n_removed"), F.sum("words").cast("long").alias("n_words"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("words"))), F.lit(0)).cast("long").alias("removed_words"),
        F.sort_array(F.collect_list(gone)).alias("removed_lines"),
    )
    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_key("text").alias("key")).distinct()

    def beside(rows: DataFrame, more: DataFrame) -> DataFrame:
        more = more.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
        both = rows.join(more, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        return both.drop("_id", "_key")

    joined, passages = beside(rows, counts), []
    if p.reach:
        joined, passages = beside(joined, repeated_passages(docs, p)), ["n_passages", "passage_words"]
    zero = F.lit(0).cast("long")
    number = {c: F.coalesce(c, zero) for c in ("n_paragraphs", "n_removed", "n_words", "removed_words", *passages)}
    if p.reach:
        number["n_removed"] = number["n_removed"] + number["n_passages"]
    return joined.select(
        "doc_id", *[number[c].alias(c) for c in ("n_paragraphs", "n_removed", "n_words", "removed_words")],
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        *[number[c].alias(c) for c in passages],
    )


def without_paragraphs(docs: DataFrame, p: Paragraphs = Paragraphs()) -> DataFrame:
    """All rows and columns, with the removed lines gone from ``text``; passages stay."""
    gone = paragraph_classes(docs, p).where("NOT kept").groupBy(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key")
    ).agg(F.collect_set("line").alias("_gone"))
    joined = docs.join(gone, (text_key("text") == F.col("_key")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return joined.withColumn("text", text).select(docs.columns)
