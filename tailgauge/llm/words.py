"""Words and word shingles of whole batches as numbers."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n or more."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        kept = np.full(size, base, np.uint64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        _powers[int(base)] = kept
    return kept[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words each text has; words do not cross texts."""
    inside = ~SPACE[data]
    begins, stops = inside.copy(), np.zeros(len(data) + 1, bool)
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]
    stops[1:-1] = inside[:-1] & ~inside[1:]
    if len(data):
        stops[-1] = inside[-1]
    stops[cuts[cuts > 0]] = inside[cuts[cuts > 0] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, ASCII letters lower-cased if asked."""
    values = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(data)), out=sums[1:]) if len(data) else None
    return mixed((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle of ``width`` words; a shorter text is one shingle of all its words."""
    n = len(counts)
    document = np.repeat(np.arange(n), counts)
    total = len(hashes)
    long = counts >= width
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    keep = np.zeros(total, bool)
    if total >= width:
        combined = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            combined = mixed(combined * BASE + hashes[k : total - width + 1 + k])
        place = np.arange(total) - first[document]
        keep = place + width <= counts[document]
        at = np.flatnonzero(keep)
        found_doc, found = document[at], combined[at]
    else:
        found_doc, found = np.empty(0, np.int64), np.empty(0, np.uint64)
    extra_doc, extra = [], []
    for d in np.flatnonzero(~long & (counts > 0)):
        value = np.zeros(1, np.uint64)
        for h in hashes[first[d] : first[d] + counts[d]]:
            value = mixed(value * BASE + h)
        extra_doc.append(d)
        extra.append(value[0])
    if extra:
        found_doc = np.concatenate([found_doc, extra_doc])
        found = np.concatenate([found, np.array(extra, np.uint64)])
        order = np.argsort(found_doc, kind="stable")
        found_doc, found = found_doc[order], found[order]
    return found_doc, found


def text_shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, counts = word_spans(data, offsets)
    return shingles(span_hashes(data, starts, ends), counts, width)
