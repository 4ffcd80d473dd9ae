"""Quality rules: repetition inside a document, by the suffix array of its words.

The suffix array of a document's words, sorted by doubling, puts equal beginnings
side by side; the intervals of its longest common prefixes are the maximal
repeated runs of words.  The union of their spans is the share of the text that
repeats, the highest prefix the longest repeat; both are limited.  The documents
of a batch are sorted together, with words of different documents unequal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import buffer_of, checked, per_batch
from .words import BASE, mixed, span_hashes, word_spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)


@dataclass(frozen=True)
class Limits:
    """Repeats of fewer than ``shortest`` words do not count; beyond the other two a document goes."""

    shortest: int = 6
    covered: float = 0.4
    longest: int = 100


def suffix_matches(symbols: np.ndarray) -> np.ndarray:
    """For every position, how many symbols from there on also start elsewhere, at most.

    Only suffixes that are not yet alone in their group are sorted again when the
    compared length doubles.
    """
    n = len(symbols)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    _, rank = np.unique(symbols, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    group = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    levels, width = [rank], 1
    place = np.repeat(np.diff(np.append(group, n)) > 1, np.diff(np.append(group, n)))
    slots = np.flatnonzero(place)
    while len(slots):
        at = order[slots]
        following = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + following
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(at)))
        rank = rank.copy()
        rank[at] = np.repeat(slots[starts], sizes)
        width *= 2
        levels.append(rank)
        slots = slots[np.repeat(sizes > 1, sizes)]
    a, b = order[:-1], order[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    found = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + found, b + found
        inside = (x < n) & (y < n)
        same = inside & (levels[level][np.minimum(x, n - 1)] == levels[level][np.minimum(y, n - 1)])
        found += np.where(same, 1 << level, 0)
    np.maximum.at(best, a, found)
    np.maximum.at(best, b, found)
    return best


def spread(lengths: np.ndarray) -> np.ndarray:
    """Flags of the positions that a span of its length from some position covers."""
    n = len(lengths)
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(lengths)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + lengths[at], -1)
    return np.cumsum(edges[:-1]) > 0


def salt(document: np.ndarray) -> np.ndarray:
    """A number for each text, so that words of different texts are unequal."""
    return mixed((document.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of true flags between each two offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def measures(data: np.ndarray, offsets: np.ndarray, shortest: int) -> dict[str, np.ndarray]:
    """All counts of a batch of texts."""
    starts, ends, counts = word_spans(data, offsets)
    word_at = np.concatenate([[0], np.cumsum(counts)])
    texts = len(counts)
    document = np.repeat(np.arange(texts), counts)
    hashes = span_hashes(data, starts, ends, lower=False)
    own = mixed(hashes ^ salt(document))
    begins = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(begins)])
    word_chars = np.diff(np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])[word_at])
    # lines: between line ends and text ends; those with a word, equal to an earlier one of the text
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    line_starts, line_ends = cuts[:-1], cuts[1:].copy()
    newline = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else line_ends > line_ends
    line_ends = line_ends - newline
    worded = np.searchsorted(starts, cuts[1:]) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    line = mixed(span_hashes(data, line_starts, line_ends, lower=False) ^ salt(line_doc))
    _, first = np.unique(line, return_index=True)
    dup_lines = np.bincount(line_doc, minlength=texts) - np.bincount(line_doc[first], minlength=texts)
    # words in windows of three that occur twice or more
    repeat = np.zeros(len(own), bool)
    if len(own) > 2:
        window = mixed(mixed(own[:-2] * BASE + own[1:-1]) * BASE + own[2:])
        inside = document[:-2] == document[2:]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = (times[back] > 1) & inside
        for k in range(3):
            repeat[k : len(own) - 2 + k] |= twice
    # every text ends in a symbol of its own, so that no run crosses texts
    marks = word_at[1:]
    symbols = np.insert(own, marks, salt(np.arange(texts)))
    is_mark = np.zeros(len(symbols), bool)
    is_mark[marks + np.arange(texts)] = True
    match = suffix_matches(symbols)[~is_mark]
    match = np.where(match >= shortest, match, 0)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, document, match)
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": dup_lines, "n_repeat_words": per_text(repeat, word_at),
        "covered_words": per_text(spread(match), word_at), "longest_repeat": longest,
    }


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Counts and verdict of every row.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    windows of three.  ``kept``: not failed, and repeats of at least ``shortest``
    words cover no more than the share ``covered`` and are no longer than
    ``longest``.  Null and empty texts have no words and fail; rows that repeat
    are judged each, and never against each other.
    """

    def judge(batch: pa.RecordBatch) -> dict:
        found = measures(*buffer_of(batch.column(1)), limits.shortest)
        n = found["n_words"]
        failed = (n < 50) | (100 * found["n_repeat_words"] > 50 * n)
        good = (found["covered_words"] <= limits.covered * n) & (found["longest_repeat"] <= limits.longest)
        return found | {"doc_id": batch.column(0), "base_failed": failed, "kept": ~failed & good}

    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return per_batch(rows, "text", judge, SCHEMA)
