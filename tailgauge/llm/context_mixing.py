"""Language-model scoring by online logistic context mixing.

Texts are coded bit by bit.  Several predictors each look up how often a zero or a
one followed their context and the bits of the present byte so far.  Contexts are
the last bytes, up to four, and the word so far, as 64-bit keys.  A mixer adds the
predictors' log-odds with weights that a gate, the bit's place in its byte, selects,
and after each bit moves the weights of that gate towards what came.  The counts are
frozen; the weights start equal and adapt from the first byte of a text to its last.
Texts of a batch are coded side by side.

Texts are dealt into batches of about ``batch`` bytes and similar lengths.  Each batch
sends every context it holds once, with the bytes that follow it and how often they
do in its training texts, to the bucket of the context's hash.  A bucket adds up what
its batches sent, which is its part of the model, and answers each batch with the
whole counts of the contexts that the batch named.  Texts meet their answers by batch, so that
no process holds the model, and texts are shuffled once.

The count of the words of all texts, which the base score needs, travels with the
same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import buffer_of, checked, remainder, ship, slices
from .words import BASE, INVERSE, LOWER, SPACE, mixed, powers, span_hashes, word_spans

#: The order of the predictor that sees the present word so far, ASCII letters lower-cased.
WORD = 0
#: Positions of a batch that a packed sort numbers.
PLACES = 24


@dataclass(frozen=True)
class Mixing:
    """``orders``: bytes of each predictor's context, at most four, or the word so far; the mixer adds them up.

    ``slot_bits`` and ``frequent`` are accepted for older callers and bound nothing.  ``batch``: bytes of the texts that
    are coded side by side and ask for their contexts at once, about; a longer text is not cut.  ``spread``: as many
    batches' worth of texts for each bucket of contexts.
    """

    orders: tuple[int, ...] = (1, 2, 3, 4, WORD)
    slot_bits: int = 22
    smoothing: float = 0.02
    rate: float = 0.02
    weight: float = 0.2
    frequent: int = 1 << 17
    batch: int = 8 << 20
    spread: int = 4


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with four zero bytes before and one, the end, behind; which bytes are coded."""
    sizes = np.diff(offsets)
    n = len(sizes)
    buffer, coded = np.zeros(len(data) + 5 * n, np.uint8), np.ones(len(data) + 5 * n, bool)
    starts = offsets[:-1] + 5 * np.arange(n)
    coded[(starts[:, None] + np.arange(4)).ravel()] = False
    inside = coded.copy()
    inside[offsets[1:] + 5 * np.arange(n) + 4] = False
    buffer[inside] = data
    return buffer, coded


def word_so_far(buffer: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes between the last white space and each position."""
    n = len(buffer)
    values = LOWER[buffer].astype(np.uint64) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    begin = np.zeros(n, np.int64)
    begin[1:] = np.where(SPACE[buffer[:-1]] | (buffer[:-1] == 0), np.arange(1, n), 0)
    np.maximum.accumulate(begin, out=begin)
    return mixed((sums[:-1] - sums[begin]) * powers(INVERSE, n)[begin])


def grouped(values: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by value, and where a new value begins; the low ``spare`` bits of the values are zero or may be left out.

    Where they are left out, a value may, rarely, begin more than once.
    """
    n = len(values)
    if n >> min(spare, PLACES):
        at = np.argsort(values, kind="stable")
    else:
        low = np.uint64((1 << PLACES) - 1)
        packed = (values & ~low) | np.arange(n, dtype=np.uint64)
        packed.sort()
        packed &= low
        at = packed.astype(np.int32)
    ordered = values[at]
    return at, np.concatenate([[True], ordered[1:] != ordered[:-1]])


def different_pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A position of each different value, how often it comes, and each position's number of the value."""
    at, first = grouped(values, PLACES)
    number = np.empty(len(values), np.int32)
    number[at] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    begin = np.flatnonzero(first)
    return at[begin], np.diff(begin, append=len(values)), number


def numbered_codes(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Numbers of the different codes below ``size``, in their order, and how many there are."""
    if size <= 1 << 26:
        found = np.zeros(size, bool)
        found[codes] = True
        number = np.cumsum(found, dtype=np.int32)
        return (number - np.int32(1)).take(codes), int(number[-1]) if size else 0
    kept, number = np.unique(codes, return_inverse=True)
    return number.astype(np.int32), len(kept)


def numbered_grams(buffer: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A coded position of each different string of a coded byte and the four before it, and each coded byte's number of the string."""
    symbol, kinds = numbered_codes(buffer, 256)
    number, n = symbol, kinds
    # two bytes, two such pairs, and one byte more
    for shift, other, m in ((1, symbol, kinds), (2, None, None), (1, symbol, kinds)):
        other, m = (number, n) if other is None else (other, m)
        codes = np.zeros(len(buffer), np.int32 if n * m < 1 << 31 else np.int64)
        np.multiply(number[:-shift], m, out=codes[shift:], dtype=codes.dtype)
        codes += other
        last = shift == 1 and number is not symbol
        number, n = numbered_codes(codes[coded] if last else codes, n * m)
    some = np.empty(n, np.int32)
    some[number] = np.arange(len(number), dtype=np.int32)
    return some, number


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """:func:`span_hashes` of neighbouring spans, about 1 MB at a time."""
    out = np.empty(len(starts), np.uint64)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)), len(starts)))
    for low, high in zip(edges[:-1], edges[1:]):
        base = starts[low]
        out[low:high] = span_hashes(data[base : ends[high - 1]], starts[low:high] - base, ends[low:high] - base, lower)
    return out


@dataclass
class Tokens:
    """The words of a batch of texts, each with the white space or end behind it; a token may be that alone.

    ``number`` and ``text`` of each token; of the different ones ``hash``, that of the word, lower-cased, and ``wordy``,
    whether there is one; ``buffer`` has the different tokens' bytes, and ``at`` is the place there of each byte of the texts.
    """

    number: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    wordy: np.ndarray
    buffer: np.ndarray | None
    at: np.ndarray | None

    @classmethod
    def of(cls, present: np.ndarray, stops: np.ndarray) -> Tokens:
        """``present``: the texts' bytes, each text with an end behind it, at ``stops``."""
        cut = SPACE[present]
        cut[stops] = True
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        some, _, number = different_pairs(hashes_of(present, starts, ends, False))
        sizes = (ends - starts)[some]
        begin = np.cumsum(sizes) - sizes
        buffer = present[np.repeat(starts[some] - begin, sizes) + np.arange(sizes.sum())]
        at = np.repeat((begin[number] - starts).astype(np.int32), ends - starts)
        at += np.arange(len(present), dtype=np.int32)
        words = hashes_of(buffer, begin, begin + sizes - 1, True)
        return cls(number, np.searchsorted(stops, ends - 1), words, sizes > 1, buffer, at)


@dataclass(frozen=True)
class Pairs:
    """The different pairs of context and coded byte of one predictor, and the ``place`` of each coded byte's pair."""

    context: np.ndarray
    byte: np.ndarray
    place: np.ndarray

    def times(self, coded: int | None = None) -> np.ndarray:
        """How often each comes, among the first ``coded`` bytes if asked."""
        return np.bincount(self.place[:coded], minlength=len(self.context))


def pairs_of(data: np.ndarray, offsets: np.ndarray, m: Mixing, tokens: Tokens | None = None) -> list[Pairs]:
    """One for each predictor; byte predictors share their places, those of the longest context."""
    buffer, coded = laid_out(data, offsets)
    out: dict[int, Pairs] = {}
    if any(order != WORD for order in m.orders):
        some, place = numbered_grams(buffer, coded)
        # the coded byte, then those before it, the nearest one first
        at = np.flatnonzero(coded)[some]
        seen = np.zeros(len(some), np.uint64)
        for k in range(5):
            seen |= buffer[at - k].astype(np.uint64) << np.uint64(56 - 8 * k)
        by = np.argsort(seen)
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        seen, place = seen[by], rank[place]
        byte = (seen >> np.uint64(56)).astype(np.int64)
        before = (seen >> np.uint64(24)) & np.uint64(0xFFFFFFFF)
        for order in m.orders:
            if order != WORD:
                out[order] = Pairs((before >> np.uint64(8 * (4 - order))).view(np.int64), byte, place)
    if WORD in m.orders:
        tokens = tokens or tokens_of(data, offsets)
        hashes = np.empty(len(tokens.buffer), np.uint64)
        # words end with their token, so about 1 MB of tokens at a time
        ends = np.flatnonzero(SPACE[tokens.buffer] | (tokens.buffer == 0)) + 1
        start = 0
        while start < len(hashes):
            stop = int(ends[max(np.searchsorted(ends, start + (1 << 20), "right") - 1, np.searchsorted(ends, start, "right"))])
            hashes[start:stop] = word_so_far(tokens.buffer[start:stop])
            start = stop
        some, _, place = different_pairs(mixed(hashes + tokens.buffer * BASE))
        place = place[tokens.at]
        out[WORD] = Pairs(hashes[some].view(np.int64), tokens.buffer[some].astype(np.int64), place)
    return [out[order] for order in m.orders]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    buffer, coded = laid_out(data, offsets)
    return Tokens.of(buffer[coded], offsets[1:] + np.arange(len(offsets) - 1))


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, ASCII letters lower-cased, and the number of words of each text."""
    starts, ends, counts = word_spans(data, offsets)
    return span_hashes(data, starts, ends).view(np.int64), counts


def arrow_of(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def runs(pairs: Pairs) -> np.ndarray:
    """Where a new pair begins; those of a shorter context are runs."""
    return np.concatenate([[True], (np.diff(pairs.context) != 0) | (np.diff(pairs.byte) != 0)])


def gather(training: DataFrame, m: Mixing) -> DataFrame:
    """The model as a table, (kind, key, byte, n): how often a byte followed a context, by predictor, and in kind 0 the words' counts."""
    schema = "kind int, key long, byte int, n long"
    arrow = arrow_of(schema)

    def rows(kind: int, key: np.ndarray, byte: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(key), kind, np.int32), key, byte.astype(np.int32), n.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", m.batch):
            for part in slices(iter([batch]), "text", 1 << 20):
                words, counts = np.unique(word_counts(*buffer_of(part.column(0)))[0], return_counts=True)
                yield rows(0, words, np.zeros_like(words), counts)
            for k, pairs in enumerate(pairs_of(*buffer_of(batch.column(0)), m)):
                begin, every = np.flatnonzero(runs(pairs)), pairs.times()
                for part in np.array_split(np.arange(len(begin)), -(-len(begin) // (1 << 16)) or 1):
                    if len(part):
                        times = np.add.reduceat(every[: begin[part[-1] + 1] if part[-1] + 1 < len(begin) else None], begin[part])
                        yield rows(k + 1, pairs.context[begin[part]], pairs.byte[begin[part]], times)

    ship(training.sparkSession)
    counted = checked(training, "text").mapInArrow(count, schema)
    return counted.groupBy("kind", "key", "byte").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Followers:
    """The bytes that followed each context of a batch, numbered, as sums of their counts in the order of ``key``."""

    key: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, number: np.ndarray, lists: np.ndarray, ends: np.ndarray) -> Followers:
        """From the answers: numbers of contexts, and lists of ``256 * n + byte`` between ``ends``."""
        key = np.repeat(number.astype(np.int64) << 8, np.diff(ends)) | (lists & 255)
        by = np.argsort(key)
        return cls(key[by], np.concatenate([[0], np.cumsum(lists[by] >> 8)]))

    def odds(self, number: np.ndarray, byte: np.ndarray, m: Mixing) -> np.ndarray:
        """(pair, place in the byte): log-odds of the bit that the byte has there; 0 where nothing was seen.

        Contexts in order are taken some at a time.
        """
        out = np.empty((len(number), 8), np.float32)
        low, most = 0, 1 << 17
        rising = bool((np.diff(number) >= 0).all())
        while low < len(number):
            high = len(number)
            if rising and low + most < high:
                high = max(low + 1, int(np.searchsorted(number, number[low + most])))
                high = high if number[high - 1] != number[high] else int(np.searchsorted(number, number[low], "right"))
            some = slice(low, high)
            first, last = (np.searchsorted(self.key, [int(number[some].min()) << 8, (int(number[some].max()) + 1) << 8]))
            part = Followers(self.key[first:last], self.sums[first : last + 1])
            out[some] = part.odds_of_all(number[some], byte[some], m)
            low = high
        return out

    def odds_of_all(self, number: np.ndarray, byte: np.ndarray, m: Mixing) -> np.ndarray:
        asked = (number.astype(np.int64) << 8) | byte
        keys = np.concatenate([self.key, asked])
        by = np.argsort(keys, kind="stable")
        counts = np.concatenate([np.diff(self.sums), np.zeros(len(asked), np.int64)])[by].astype(float)
        place = np.empty(len(keys), np.int64)
        place[by] = np.arange(len(keys))
        place, keys = place[len(self.key) :], keys[by]
        changed = keys[1:] ^ keys[:-1]
        out = np.empty((len(asked), 8), np.float32)
        # the sums of nodes are those of runs; the first ones are whole contexts
        for k in range(9):
            first = np.flatnonzero(np.concatenate([[True], changed >> (8 - k) != 0])[: len(keys)])
            sums = np.add.reduceat(counts, first) if len(first) else counts
            same = sums.repeat(np.diff(first, append=len(keys)))[place]
            if k:
                out[:, k - 1] = np.log((same + m.smoothing) / (whole - same + m.smoothing))  # noqa: F821
            whole = same  # noqa: F841
        return out


def code_lengths(
    inputs: list[np.ndarray], pairs: list[np.ndarray], starts: np.ndarray, sizes: np.ndarray, m: Mixing
) -> np.ndarray:
    """Natural-log code length of every text; the weights of a text are carried from its first byte to its last."""
    by = np.argsort(-sizes, kind="stable")
    begin, length = starts[by], sizes[by]
    # how many texts are longer than each step
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left").tolist()
    total = np.zeros((len(length), 8))
    # negative weights give the negative log-odds of the bit that comes
    weights = np.full((len(inputs), len(length), 8), -m.weight, np.float32)
    xs, parts = np.empty_like(weights), np.empty_like(weights)
    odds, spare, product = (np.ones((len(length), 8), np.float32) for _ in range(3))
    # predictors of one place are looked up at once
    shared = list({id(pair): pair for pair in pairs}.values())
    which = [next(k for k, x in enumerate(shared) if x is pair) for pair in pairs]
    ahead = np.arange(64)
    least, most, rate, one = np.float32(-12), np.float32(12), np.float32(-m.rate), np.float32(1)
    n = -1
    for t, still in enumerate(active):
        if still != n:
            n = still
            x, w, part = xs[:, :n], weights[:, :n], parts[:, :n]
            sources, dot, e, over = list(zip(inputs, which, x)), odds[:n], spare[:n], product[:n]
        step = t % len(ahead)
        if not step:
            # places of the next steps, step by step
            soon = begin[:n, None] + (t + ahead)
            blocks = [pair.take(soon, mode="clip").T.copy() for pair in shared]
        at = [block[step, :n] for block in blocks]
        for source, k, row in sources:
            source.take(at[k], axis=0, out=row, mode="clip")
        np.multiply(x, w, out=part)
        np.add.reduce(part, axis=0, out=dot)
        np.minimum(dot, most, out=dot)
        np.maximum(dot, least, out=dot)
        np.exp(dot, out=dot)
        np.add(dot, one, out=e)
        np.multiply(over, e, out=over)
        np.divide(dot, e, out=dot)
        np.multiply(dot, rate, out=dot)
        np.multiply(x, dot, out=x)
        np.add(w, x, out=w)
        # six factors of up to 1 + e**12 stay in range
        if t % 6 == 5 or t + 1 == len(active):
            among = active[t - t % 6]
            total[:among] += np.log(product[:among])
            product[:among] = 1
    out = np.empty(len(by))
    out[by] = total.sum(1)
    return out


#: Texts of similar lengths are coded side by side: bytes from which a next class of them begins.
LENGTHS = (1 << 12, 1 << 14, 1 << 15, 1 << 16)
SENT = "bucket int, batch long, kind int, keys binary, counts binary"
ANSWER = "batch long, bucket int, kind int, sizes binary, bytes binary, counts binary, check long"
WORDS, CONTEXTS = 0, 1
#: The batch to which buckets report how many different words they hold, and how many in all.
REPORT = -1
LOW = np.uint64(0xFF)


def planes(values: np.ndarray) -> bytes:
    """Numbers of up to eight bytes as their width, all their lowest bytes, then all their next ones, which compresses well."""
    if not len(values):
        return b""
    width = max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([width]) + values.astype(np.uint64).view(np.uint8).reshape(len(values), 8)[:, :width].T.tobytes()


def from_planes(stored: bytes, kind: type = np.int64) -> np.ndarray:
    if not stored:
        return np.empty(0, kind)
    found = np.frombuffer(stored, np.uint8, offset=1).reshape(stored[0], -1)
    out = np.zeros((found.shape[1], 8), np.uint8)
    out[:, : stored[0]] = found.T
    return out.view(kind).ravel()


def steps_of(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def check_of(keys: np.ndarray) -> int:
    return int(np.add.reduce(keys, dtype=np.uint64).view(np.int64)) if len(keys) else 0


def context_keys(pairs: Pairs, kind: int, where: np.ndarray) -> np.ndarray:
    """56-bit hash of each context and predictor, and zeros."""
    return mixed(pairs.context[where].view(np.uint64) * BASE + mixed(np.array([kind + 1], np.uint64))) & ~LOW


def added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    by = np.argsort(keys)
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Batch:
    """Texts that are coded side by side, with their different words and pairs."""

    def __init__(self, texts: pa.Table, m: Mixing):
        held_out = texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        # those to learn from come first
        self.texts = texts.take(pa.array(np.argsort(held_out, kind="stable")))
        self.data, self.offsets = buffer_of(self.texts.column("text"))
        self.sizes = np.diff(self.offsets) + 1
        self.learned = int((~held_out).sum())
        self.tokens = tokens_of(self.data, self.offsets)
        self.pairs = pairs_of(self.data, self.offsets, m, self.tokens)
        self.tokens.at = self.tokens.buffer = None  # as large as the texts
        self.runs = [np.flatnonzero(runs(p)) for p in self.pairs]
        keys = [context_keys(p, k, at) | p.byte[at].astype(np.uint64) for k, (p, at) in enumerate(zip(self.pairs, self.runs))]
        #: keys of all different pairs, and the number of each predictor's pairs among them
        self.keys, number = np.unique(np.concatenate(keys), return_inverse=True)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        self.number = [
            x.astype(np.int32).repeat(np.diff(at, append=len(p.context)))
            for x, at, p in zip(np.split(number, cuts), self.runs, self.pairs)
        ]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the different words, and how often each comes in the texts to learn from."""
        t = self.tokens
        times = np.bincount(t.number[t.text < self.learned], minlength=len(t.hash))
        return added_up(t.hash[t.wordy], times[t.wordy])

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Different contexts' keys with the byte that follows, and how often it does in the texts to learn from."""
        known = int(self.sizes[: self.learned].sum())
        times = {id(p.place): p.times(known) for p in self.pairs}
        counts = np.zeros(len(self.keys))
        for p, number in zip(self.pairs, self.number):
            counts += np.bincount(number, weights=times[id(p.place)], minlength=len(counts))
        return self.keys, counts.astype(np.int64)

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """Different contexts' keys, in order, and the number of the context of each of ``keys``."""
        contexts = self.keys & ~LOW
        first = np.concatenate([[True], contexts[1:] != contexts[:-1]])
        return contexts[first], np.cumsum(first) - 1


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the bucket, which rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def in_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end."""
    return np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))


def sent(texts: DataFrame, buckets: int, m: Mixing) -> DataFrame:
    """One row for each batch, bucket and kind: keys of the words, or of contexts with a following byte, and their counts."""
    arrow = arrow_of(SENT)

    def send(texts: pa.Table) -> pa.Table:
        number, batch = texts.column("batch")[0].as_py(), Batch(texts, m)
        out = []
        for kind, (keys, counts) in ((WORDS, batch.words()), (CONTEXTS, batch.contexts())):
            cuts = in_buckets(keys, buckets)
            for bucket, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
                part = planes(steps_of(keys[low:high])), planes(counts[low:high])
                out.append((bucket, number, kind, *part))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    ship(texts.sparkSession)
    return texts.groupBy("batch").applyInArrow(send, SENT)


def spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of each range, one range after the other."""
    sizes = high - low
    return np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def answered(rows: DataFrame) -> DataFrame:
    """For each row of :func:`sent` the whole counts of its words, or all bytes that follow its contexts with theirs.

    ``check`` sums the keys of a row; the bucket's own numbers go to batch ``REPORT``.
    """
    arrow = arrow_of(ANSWER)

    def answer(table: pa.Table) -> pa.Table:
        bucket, batches = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
        kinds = np.array(table.column("kind").to_pylist())
        asked = [np.cumsum(from_planes(x.as_py(), np.uint64), dtype=np.uint64) for x in table.column("keys")]
        counts = [from_planes(x.as_py()) for x in table.column("counts")]
        out = []
        for kind in (WORDS, CONTEXTS):
            mine = np.flatnonzero(kinds == kind).tolist()
            keys, totals = added_up(np.concatenate([asked[i] for i in mine]), np.concatenate([counts[i] for i in mine]))
            if kind == WORDS:
                whole = np.array([(totals > 0).sum(), totals.sum()], np.int64)
                out.append((REPORT, bucket, kind, b"", b"", planes(whole), 0))
                for i in mine:
                    found = totals[np.searchsorted(keys, asked[i])]
                    out.append((batches[i], bucket, kind, b"", b"", planes(found), check_of(asked[i])))
                continue
            keys, totals = keys[totals > 0], totals[totals > 0]
            bytes_ = (keys & LOW).astype(np.uint8)
            for i in mine:
                contexts = asked[i] & ~LOW
                contexts = contexts[np.concatenate([[True], contexts[1:] != contexts[:-1]])[: len(contexts)]]
                low, high = np.searchsorted(keys, contexts), np.searchsorted(keys, contexts | LOW, "right")
                at = spans(low, high)
                sizes = planes(high - low)
                out.append((batches[i], bucket, kind, sizes, bytes_[at].tobytes(), planes(totals[at]), check_of(contexts)))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    ship(rows.sparkSession)
    return rows.groupBy("bucket").applyInArrow(answer, ANSWER)


SCORED = (
    "doc_id long, held_out boolean, n_words long, known long, logs double, score double, bits_per_byte double, "
    "distinct long, total long"
)


def scored(texts: DataFrame, answers: DataFrame, m: Mixing) -> DataFrame:
    """One row for each text, without ``distinct`` and ``total``; the others have these alone, of the words of one bucket."""
    arrow = arrow_of(SCORED)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        kind = answers.column("kind").to_numpy()
        words, contexts = answers.filter(pa.array(kind == WORDS)), answers.filter(pa.array(kind == CONTEXTS))
        times = [from_planes(x.as_py()) for x in words.column("counts")]
        if not texts.num_rows:
            some = {"distinct": [x[0] for x in times], "total": [x[1] for x in times]}
            return pa.Table.from_arrays(
                [pa.array(some[f.name], f.type) if f.name in some else pa.nulls(len(times), f.type) for f in arrow], schema=arrow
            )
        batch = Batch(texts, m)
        keys, (named, context) = batch.words()[0], batch.named()
        for found, checks in ((keys, words), (named, contexts)):
            if sum(checks.column("check").to_pylist()) % (1 << 64) != check_of(found) % (1 << 64):
                raise ValueError("the texts of a batch are not those that asked")
        # the base score: words by their tokens
        t = batch.tokens
        counts = np.concatenate(times)[np.minimum(np.searchsorted(keys, t.hash), max(len(keys) - 1, 0))] if len(keys) else np.zeros(len(t.hash), np.int64)
        counts = np.where(t.wordy, counts, 0)
        n = len(batch.sizes)
        own = {
            "n_words": np.bincount(t.text, weights=t.wordy[t.number], minlength=n),
            "known": np.bincount(t.text, weights=(counts > 0)[t.number], minlength=n),
            "logs": np.bincount(t.text, weights=np.log10(counts + 1.0)[t.number], minlength=n),
        }
        # the score
        join = lambda name: b"".join(x.as_py() for x in contexts.column(name))
        sizes = np.concatenate([from_planes(x.as_py()) for x in contexts.column("sizes")])
        totals = np.concatenate([from_planes(x.as_py()) for x in contexts.column("counts")])
        number = np.repeat(np.arange(len(named)) << 8, sizes) | np.frombuffer(join("bytes"), np.uint8)
        followers = Followers(number, np.concatenate([[0], np.cumsum(totals)]))
        odds = followers.odds(context, (batch.keys & LOW).astype(np.int64), m)
        inputs = [odds[x] for x in batch.number]
        del followers, number, totals, sizes, odds
        starts = np.cumsum(batch.sizes) - batch.sizes
        lengths = code_lengths(inputs, [p.place for p in batch.pairs], starts, batch.sizes, m)
        own |= {"score": -lengths / np.log(10), "bits_per_byte": lengths / np.log(2) / batch.sizes}
        own |= {name: batch.texts.column(name).combine_chunks() for name in ("doc_id", "held_out")}
        return pa.Table.from_arrays(
            [pa.array(own[f.name]).cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in arrow], schema=arrow
        )

    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, SCORED)


def language_model_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, m: Mixing = Mixing()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    Learns from the rows outside fold ``held_out``.  Null texts are empty: their
    only token, and their only coded byte, is the end.  Words are compared by a
    64-bit hash, contexts by one of 56 bits.  ``score`` is the base-10 logarithm of the text's probability,
    ``bits_per_byte`` the whole code length over the coded bytes.  Rows that repeat are scored each and counted each; an empty
    table gives an empty result.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = checked(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), "text", (remainder("doc_id", folds) == held_out).alias("held_out")
    )
    kind = sum((F.when(size > x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    sums = {r.kind: r for r in rows.groupBy(kind.alias("kind")).agg(
        F.sum(size).alias("bytes"), F.sum(F.when(F.col("held_out"), 0).otherwise(1)).alias("texts")
    ).collect()}
    batches = [-(-sums[k].bytes // m.batch) if k in sums else 1 for k in range(len(LENGTHS) + 1)]
    buckets = max(1, -(-sum(r.bytes for r in sums.values()) // (m.batch * m.spread)))
    texts = sum(r.texts for r in sums.values())
    # equal rows are dealt out too
    place = F.xxhash64("doc_id", F.monotonically_increasing_id())
    before = [sum(batches[:k]) for k in range(len(batches))]
    choose = lambda values: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), (kind + 1).cast("int"))
    dealt = rows.withColumn("batch", choose(before) + F.pmod(place, choose(batches)))
    answers = answered(sent(dealt, buckets, m))
    parts = materialize(scored(dealt, answers, m), "mixing-scores")
    known = parts.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    distinct, total = known[0] + (texts > 0), known[1] + texts
    tokens = F.col("n_words") + 1
    logs = F.col("logs") + F.log10(F.lit(texts + 1.0))
    return parts.where("distinct IS NULL").select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + F.lit(int(texts > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs - tokens * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), "score", "bits_per_byte",
    )
