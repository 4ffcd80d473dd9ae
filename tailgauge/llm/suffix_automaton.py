"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton over words accepts every run of words of every item.  Streaming a
document through it gives at each word the longest run ending there that occurs
in some item; a window of ``window`` words ends there if the run is that long, and
the automaton's state tells which items hold it.  Items shorter than a window
count whole.  Words that no item has reset the state, so only stretches of known
words are streamed.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import checked, per_batch, ship

#: Fixed: what separates words, and the lower-casing of ASCII letters only.
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Bytes of item texts in one automaton, which is what a task holds; more items take more passes.
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, row long, n_words long, spans array<struct<low:int,high:int>>, items array<string>"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class Automaton:
    """Generalised suffix automaton over word numbers.

    States hold their transitions, the length of their longest run and their
    suffix link; ``held`` maps a state to the items whose window it accepts at
    exactly ``window`` words, ``short`` to the short items that end in it.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = array("q", [0]), array("q", [-1])
        for _, item in items:
            self._add([self.number.setdefault(w, len(self.number)) for w in item])
        self.held: dict[int, list[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, item in items:
            self._mark(name, [self.number[w] for w in item])
        self.least = min([window, *(n for x in self.short.values() for n, _ in x)])
        self._nearest: dict[int, int] = {}

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the shorter runs that reach it by ``p`` and its links."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, item: list[int]) -> None:
        last = 0
        for word in item:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest run after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def at_length(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what ``state`` has read."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _mark(self, name: str, item: list[int]) -> None:
        state = length = 0
        for word in item:
            state, length = self.step(state, length, word)
            if length >= self.window:
                holders = self.held.setdefault(self.at_length(state, self.window), [])
                if not holders or holders[-1] != name:
                    holders.append(name)
        if 0 < length < self.window:
            self.short.setdefault(self.at_length(state, length), []).append((length, name))

    def endings(self, state: int) -> int:
        """The nearest state by links, itself included, in which a short item ends; 0 if none."""
        path = []
        while state and state not in self.short:
            if state in self._nearest:
                state = self._nearest[state]
                break
            path.append(state)
            state = self.link[state]
        for s in path:
            self._nearest[s] = state
        return state

    def matches(self, text: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words and the items with occurring windows."""
        known = [self.number.get(w, -1) for w in text]
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        states: set[int] = set()
        i = 0
        for end in [*(k for k, w in enumerate(known) if w < 0), len(known)]:
            if end - i >= self.least:
                state = length = 0
                for k in range(i, end):
                    state, length = self.step(state, length, known[k])
                    if length < self.least:
                        continue
                    size = 0
                    if length >= self.window:
                        size = self.window
                        states.add(self.at_length(state, size))
                    if self.short:
                        s, reach = self.endings(state), length
                        while s:
                            for m, name in self.short[s]:
                                if m <= reach:
                                    found.add(name)
                                    size = max(size, m)
                            s = self.endings(self.link[s])
                    if size:
                        low = k + 1 - size
                        while spans and spans[-1][1] >= low:
                            low = min(low, spans.pop()[0])
                        spans.append((low, k + 1))
            i = end + 1
        for s in states:
            found.update(self.held[s])
        return spans, found


def item_blocks(benchmark: DataFrame, block_bytes: int):
    """Items in blocks of bounded text, streamed to the driver one block at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    for row in checked(benchmark, "item_id", "text").where("text IS NOT NULL").select(
        F.col("item_id").cast("string"), "text"
    ).toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id or "", row.text))
        size += len(row.text)
    yield block


def one_block(docs: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    """Spans and items of every row against one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_bytes
    built: list[Automaton] = []

    def stream(batch: pa.RecordBatch) -> dict:
        if not built:
            items = [(name, words(text)) for name, text in shared.value]
            built.append(Automaton([x for x in items if x[1]], window))
        out: dict[str, list] = {"n_words": [], "spans": [], "items": []}
        for text in batch.column(1).to_pylist():
            tokens = words(text)
            spans, items = built[0].matches(tokens)
            out["n_words"].append(len(tokens))
            out["spans"].append([{"low": a, "high": b} for a, b in spans])
            out["items"].append(sorted(items))
        return out | {"doc_id": batch.column(0), "row": batch.column(2)}

    return per_batch(docs, "text", stream, SCHEMA)


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row; spans are of word numbers and do not touch.

    Null and empty texts have no words; items without words match nothing; items
    that repeat are one by id.  One pass over the documents where the items fit a
    block, else one for each block, whose spans are then merged by row.
    """
    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return one_block(rows.withColumn("row", F.lit(0).cast("long")), first, window).drop("row")
    numbered = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    found = materialize(one_block(numbered, first, window), "decontaminate-block")
    while second is not None:
        found = found.unionByName(materialize(one_block(numbered, second, window), "decontaminate-block"))
        second = next(blocks, None)
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    start = F.array().cast("array<struct<low:int,high:int>>")
    last = lambda x: F.element_at(x, -1)
    joined = F.aggregate(
        "spans", start,
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["high"] >= s["low"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(last(out)["low"].alias("low"), F.greatest(last(out)["high"], s["high"]).alias("high"))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items")


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for every row.

    A document is contaminated if at least one word in ``share`` is hit.
    """
    found = contaminated_spans(docs, benchmark, window, block_bytes)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["high"] - s["low"]))
    return found.withColumn("n_hit", hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows that are not contaminated, all columns unchanged.

    Where the items fit one block each row is judged where it is read; otherwise
    the verdict over all blocks is joined to numbered rows.
    """
    blocks = item_blocks(benchmark, block_bytes)
    block, second = next(blocks), next(blocks, None)
    if second is not None:
        numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate-docs")
        rows = numbered.select(F.col("_row").alias("doc_id"), "text")
        dirty = contamination_report(rows, benchmark, window, share, block_bytes).where("contaminated")
        return numbered.join(dirty.select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    at = docs.columns.index("text")
    built: list[Automaton] = []
    ship(docs.sparkSession)

    def keep(batches):
        if not built:
            items = [(name, words(text)) for name, text in shared.value]
            built.append(Automaton([x for x in items if x[1]], window))
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                tokens = words(text)
                hit = sum(b - a for a, b in built[0].matches(tokens)[0])
                clean.append(not (hit and share * hit >= len(tokens)))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
