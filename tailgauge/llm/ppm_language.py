"""Language identification by prediction by partial matching.

Training counts, for every language, which byte followed each context of zero to
three bytes.  From the counts a language's context tree gets its probabilities:
a context that saw ``n`` bytes of ``q`` kinds gives a seen byte ``c / (n + q)``
and leaves ``q / (n + q)`` to the escape, which spreads over the other bytes as
the next shorter context has them (exclusion).  Every context's probabilities
sum to one, so the code lengths are exact.  The statistics are then frozen: a
text's code length under each language is the sum over its bytes, and the
shortest wins.

The trees of all languages share one table of contexts (row, byte, language), so
a byte costs one lookup.  Its size has a documented bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import buffer_of, checked, forget_others, per_batch, remainder, ship, slices

ORDER = 3
#: Three line ends stand before each text, so every byte has a full context.
LEAD = 10
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass(frozen=True)
class ContextTrees:
    """``row[a, b, c]`` is the table row of the longest kept context; ``bits`` its code lengths."""

    langs: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol
    row: np.ndarray  # (symbols ** 3) int32
    bits: np.ndarray  # (rows * symbols, langs) float32

    @classmethod
    def build(cls, langs: list[str], grams: np.ndarray, counts: np.ndarray, max_rows: int) -> ContextTrees:
        """``grams``: (n, 5) of language, three context bytes and byte; ``counts``: how often."""
        symbol = np.zeros(256, np.int64)
        used = np.unique(grams[:, 1:])
        symbol[used] = np.arange(1, len(used) + 1)  # 0 stands for every byte never seen
        a, n = len(used) + 1, len(langs)
        g = np.column_stack([grams[:, 0], symbol[grams[:, 1:]]])
        share = np.full(a, 1 / 256)
        share[0] = (256 - len(used)) / 256
        levels = [np.broadcast_to(share, (n, 1, a))]
        keys = [np.zeros(1, np.int64)]
        context = np.zeros(len(g), np.int64)
        for order in range(ORDER + 1):
            context = np.zeros(len(g), np.int64)
            for k in range(ORDER - order, ORDER):
                context = context * a + g[:, 1 + k]
            if order < ORDER:
                wanted = np.arange(a**order) if order < 2 else np.unique(context)
            else:
                total = np.bincount(np.unique(context, return_inverse=True)[1], weights=counts)
                wanted = np.unique(context)[np.sort(np.argsort(-total, kind="stable")[:max_rows])]
            at = np.searchsorted(wanted, context)
            ok = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == context)
            seen = np.zeros((n, len(wanted), a))
            np.add.at(seen, (g[ok, 0], at[ok], g[ok, 4]), counts[ok])
            shorter = wanted % max(1, a ** (order - 1)) if order else wanted
            up = np.searchsorted(keys[-1], shorter)
            up = np.where((up < len(keys[-1])) & (keys[-1][np.minimum(up, len(keys[-1]) - 1)] == shorter), up, 0)
            lower = levels[-1][:, up]
            kinds, every = (seen > 0).sum(2, keepdims=True), seen.sum(2, keepdims=True)
            rest = np.where(seen > 0, 0, lower)
            left = rest.sum(2, keepdims=True)
            kinds = np.where(left > 0, kinds, 0)  # nothing to escape to
            scale = np.maximum(every + kinds, 1)
            here = seen / scale + np.where(left > 0, kinds / scale / np.where(left > 0, left, 1), 0) * rest
            levels.append(np.where(every > 0, here, lower))
            keys.append(wanted)
        # contexts of three that are not kept use their last two bytes, else their last one
        first3, first2 = 0, len(keys[4])
        first1 = first2 + len(keys[3])
        row = np.full(a**3, -1, np.int32)
        row[:] = first1 + np.arange(a**3) % a
        two = np.full(a * a, -1, np.int64)
        two[keys[3]] = first2 + np.arange(len(keys[3]))
        by_two = two[np.arange(a**3) % (a * a)]
        row = np.where(by_two >= 0, by_two, row).astype(np.int32)
        row[keys[4]] = first3 + np.arange(len(keys[4]))
        table = np.concatenate([levels[4], levels[3], levels[2]], axis=1)
        bits = -np.log2(table).transpose(1, 2, 0).reshape(-1, n).astype(np.float32)
        return cls(tuple(langs), symbol, row, np.ascontiguousarray(bits))

    def code_lengths(self, texts: pa.Array, step: int = 1 << 20) -> np.ndarray:
        """Bits of every text under every language."""
        data, offsets = buffer_of(texts)
        n, a = len(offsets) - 1, round(len(self.row) ** (1 / 3))
        lead = np.full(ORDER, self.symbol[LEAD])
        sizes = np.diff(offsets)
        out = np.zeros((n, len(self.langs)))
        document = np.repeat(np.arange(n), sizes)
        for at in range(0, len(data), step):
            stop = min(len(data), at + step)
            s = self.symbol[data[max(0, at - ORDER) : stop]]
            s = np.concatenate([lead[: ORDER - min(at, ORDER)], s])
            before = [s[ORDER - k : len(s) - k] for k in (3, 2, 1)]
            place = np.arange(at, stop) - offsets[document[at:stop]]
            for k, values in zip((3, 2, 1), before):
                np.copyto(values := values.copy(), self.symbol[LEAD], where=place < k)
                before[3 - k] = values
            rows = self.row[(before[0] * a + before[1]) * a + before[2]]
            bits = self.bits[rows.astype(np.int64) * a + s[ORDER:]]
            low, high = document[at], document[stop - 1] + 1
            cuts = np.maximum(offsets[low:high], at) - at
            full = sizes[low:high] > 0
            out[low:high][full] += np.add.reduceat(bits, cuts[full], axis=0, dtype=np.float64)
        return out


def bounded_sample(labelled: DataFrame, sample_docs: int, max_bytes: int) -> DataFrame:
    """At most ``sample_docs`` whole texts of each language, those of up to ``max_bytes`` first.

    Ids are dealt into ``sample_docs`` buckets by a hash and each bucket gives the
    id with the least hash among its shorter texts, or among all if it has no
    shorter one; so a language that occurs in long texts only is learned too.  Only
    numbers are shuffled and every task combines its own first.  One row is taken
    where a row repeats.
    """
    size = F.octet_length("text")
    keyed = labelled.where(size > 0).select(
        "lang", "text", (size > max_bytes).alias("long"), F.xxhash64("doc_id", F.lit(10)).alias("h")
    )
    best = keyed.groupBy("lang", F.pmod("h", F.lit(sample_docs)).alias("bucket")).agg(F.min(F.struct("long", "h")).alias("best"))
    chosen = keyed.join(best.select("lang", "best.long", "best.h"), ["lang", "long", "h"])
    return chosen.groupBy("lang", "h").agg(F.max("text").alias("text"))


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each three-byte context and byte occur, packed into one long."""

    def count(batch: pa.RecordBatch) -> dict:
        langs, grams, counts = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = bytes([LEAD] * ORDER) + text.encode()
            for at in range(0, len(raw) - ORDER, 1 << 20):
                b = np.frombuffer(raw[at : at + (1 << 20) + ORDER], np.uint8).astype(np.int64)
                packed = ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8)) | b[3:]
                values, n = np.unique(packed, return_counts=True)
                langs += [lang] * len(values)
                grams.append(values)
                counts.append(n)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return {"lang": langs, "gram": join(grams), "n": join(counts)}

    rows = per_batch(sample.select("lang", "text"), "text", count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, sample_docs: int = 200, max_bytes: int = 8192, max_rows: int = 8192) -> ContextTrees | None:
    """Context trees of the languages in ``labelled`` (doc_id, text, lang); None without any text.

    What reaches the driver is counts over the sample of at most ``sample_docs`` texts a
    language: no more rows than different contexts of three bytes and bytes in them.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    got = gram_counts(bounded_sample(usable, sample_docs, max_bytes)).toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    number = {x: i for i, x in enumerate(langs)}
    g = got.column("gram").to_numpy()
    grams = np.column_stack([[number[x] for x in names], g >> 24, (g >> 16) & 255, (g >> 8) & 255, g & 255])
    return ContextTrees.build(langs, grams, got.column("n").to_numpy().astype(float), max_rows)


def identify(docs: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row; reads the text alone.

    ``score`` is the best language's share when each language counts two to the
    minus of its code length.  Null texts and texts without a letter are ``und``
    with score 0; so is everything when nothing was learned.  Ties go to the
    first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by max_rows

    def score(batch: pa.RecordBatch) -> dict:
        model, texts = shared.value, batch.column(1)
        letters = [bool(x) and LETTER.search(x) is not None for x in texts.to_pylist()]
        if model is None:
            return {"doc_id": batch.column(0), "lang_pred": [UNKNOWN] * len(letters), "score": [0.0] * len(letters)}
        bits = model.code_lengths(texts)
        best = bits.argmin(1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        return {
            "doc_id": batch.column(0),
            "lang_pred": [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters)],
            "score": np.where(letters, share, 0.0),
        }

    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return per_batch(rows, "text", score, SCHEMA)


def language_id(docs: DataFrame, folds: int = 3, held_out: int = 1, **training) -> DataFrame:
    """Learn from the rows outside fold ``held_out`` that have a language, predict all rows.

    Returns doc_id, held_out, lang_pred, score; see :func:`identify` for nulls,
    empty texts and ties.  Rows that repeat are answered each.
    """
    rows = checked(docs, "doc_id", "text", "lang")
    trees = train(rows.where(remainder("doc_id", folds) != held_out), **training)
    return identify(rows, trees).withColumn("held_out", remainder("doc_id", folds) == held_out).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def keep_known(docs: DataFrame, min_score: float = 0.5, folds: int = 3, held_out: int = 1, **training) -> DataFrame:
    """The rows whose language was recognised with at least ``min_score``, all columns unchanged.

    The prediction is joined to its row inside the batch, so texts are not shuffled.
    """
    trees = train(checked(docs, "doc_id", "text", "lang").where(remainder("doc_id", folds) != held_out), **training)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index("text")

    def keep(batches):
        forget_others(__name__)
        for batch in slices(batches, "text", 1 << 20):
            model, texts = shared.value, batch.column(at)
            if model is None:
                continue
            bits = model.code_lengths(texts)
            share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            letters = [bool(x) and LETTER.search(x) is not None for x in texts.to_pylist()]
            yield batch.filter(pa.array(np.array(letters, bool) & (share >= min_score)))

    ship(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
