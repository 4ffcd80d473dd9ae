"""Byte-level BPE by a tree of joins.

A string's tokens are those of its halves, joined.  A join re-encodes a window
around the seam and lets it grow until nothing outside can change: a sequence of
tokens is the encoding of its bytes exactly if each two neighbours are the
encoding of their own bytes, so it is enough that the neighbours at both ends of
the re-encoded window agree.  Inside the halves they already do.  The join is
associative, so long runs without a break, which the direct method merges in
quadratic time, cost a logarithmic number of levels.  Decoding concatenates the
tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import checked, per_batch, remembers

#: Strings up to this many bytes are encoded in one go.
LEAF = 16
NONE = 1 << 60
#: A worker remembers at most twice as many stretches and words, and so many pairs of tokens.
REMEMBERED, WORDS, PAIRS = 120_000, 180_000, 400_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeEncoder:
    """Encodes byte strings by merge ranks; ``encode`` takes one match of the pattern."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._agree: dict[int, bool] = {}
        self._edges: dict[int, dict[int, list[tuple[bytes, int]] | None]] = {0: {}, -1: {}}
        # each token's longest beginning that is a token, or none
        self.shorter: dict[int, int | None] = {}
        # the beginnings of tokens, three bytes or more, with the longest token that each begins with
        self.longest: dict[bytes, int] = {}
        for token in sorted(ranks, key=len):
            known = [ranks[part] for size in range(len(token) - 1, 0, -1) if (part := token[:size]) in ranks]
            self.shorter[ranks[token]] = known[0] if known else None
            for size in range(3, len(token)):
                if token[:size] not in self.longest:
                    self.longest[token[:size]] = next(x for x in known if len(self.tokens[x]) < size)
            if len(token) > 2:
                self.longest[token] = ranks[token]
        self.sizes = {rank: len(token) for token, rank in ranks.items()}

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.leaf_tokens(piece)
        middle = len(piece) // 2
        return self.join(self.tree(piece[:middle]), self.tree(piece[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenated bytes of two encodings."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            head, tail = left[:-a] if a < len(left) else [], right[b:]
            window = self.decode(left[-a:] + right[:b])
            inner = self.merge(window)
            grow_left = bool(head) and not self.agree(head[-1], inner[0])
            grow_right = bool(tail) and not self.agree(inner[-1], tail[0])
            if not grow_left and not grow_right:
                return head + inner + tail
            a, b = min(len(left), 2 * a) if grow_left else a, min(len(right), 2 * b) if grow_right else b

    def leaf_tokens(self, piece: bytes) -> list[int]:
        """The one sequence of tokens whose neighbours all agree, found left to right.

        Each place takes the longest token that agrees with the one before; where
        none does, the token before gives way to its next shorter one.
        """
        get, agreed, shorter, longest, sizes = self.ranks.get, self._agree, self.shorter, self.longest, self.sizes
        n, at, last = len(piece), 0, None
        ids: list[int] = []
        while at < n:
            # beginnings of tokens: if one is none, no longer one is
            end, token = at + 3, None
            while end <= n and (further := longest.get(piece[at:end])) is not None:
                token, end = further, end + 1
            if token is None and (token := get(piece[at : at + 2])) is None:
                token = get(piece[at : at + 1])
            while True:
                if token is None:
                    # the token before gives way
                    token = ids.pop()
                    at -= sizes[token]
                    token, last = shorter[token], ids[-1] if ids else None
                elif last is None:
                    if sizes[token] < n or self.merge(piece) == [token]:
                        break
                    token = shorter[token]
                elif (good := agreed.get(last << 32 | token)) or good is None and self.agree(last, token):
                    break
                else:
                    token = shorter[token]
            ids.append(token)
            last = token
            at += sizes[token]
        return ids

    def agree(self, first: int, second: int) -> bool:
        """Whether the two tokens are the encoding of their concatenated bytes."""
        pair = first << 32 | second
        found = self._agree.get(pair)
        if found is None:
            if len(self._agree) > PAIRS:
                self._agree.clear()
            found = self.apart(first, second)
            self._agree[pair] = found
        return found

    def apart(self, first: int, second: int) -> bool:
        """Whether no merge crosses the seam of the two tokens, as their own merges go on by rank.

        Only the last part of the first token and the first part of the second can
        meet; each stays until the merge that takes it into a longer one.
        """
        ends, begins = self.edge(first, -1), self.edge(second, 0)
        if ends is None or begins is None:
            return self.merge(self.tokens[first] + self.tokens[second]) == [first, second]
        get, i, j = self.ranks.get, 0, 0
        while True:
            (left, left_goes), (right, right_goes) = ends[i], begins[j]
            rank = get(left + right, NONE)
            # of equal ranks the leftmost pair is merged first: the first token's own, the crossing one, the second's
            if rank < left_goes and rank <= right_goes and rank != NONE:
                return False
            if left_goes == right_goes == NONE:
                return True
            if left_goes <= right_goes:
                i += 1
            else:
                j += 1

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """The parts that stand at one end of a token while it is merged, each with the rank of the merge that ends it.

        None if the token's ranks do not grow from merge to merge, or do not lead to it.
        """
        known = self._edges[side]
        if token not in known:
            get, piece = self.ranks.get, self.tokens[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            found, before = [], -1
            while len(parts) > 1:
                costs = [get(x + y, NONE) for x, y in zip(parts, parts[1:])]
                least = min(costs)
                if least == NONE or least < before:
                    break
                at, before = costs.index(least), least
                if at == (0 if side == 0 else len(costs) - 1):
                    found.append((parts[side], least))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known[token] = [*found, (piece, NONE)] if len(parts) == 1 else None
        return known[token]

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of least rank, the leftmost of equals, until none is left."""
        if len(piece) > 8 * self.leaf:
            return self.merge_long(piece)
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        costs = [get(x + y, NONE) for x, y in zip(parts, parts[1:])]
        while costs and (least := min(costs)) != NONE:
            at = costs.index(least)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at < len(costs):
                costs[at] = get(parts[at] + parts[at + 1], NONE)
            if at:
                costs[at - 1] = get(parts[at - 1] + parts[at], NONE)
        return [self.ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs, for windows that had to grow far."""
        get, n = self.ranks.get, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(get(parts[i] + parts[i + 1], NONE), i, 1, 1) for i in range(n - 1)]
        heap = [x for x in heap if x[0] != NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (rank := get(parts[i] + parts[j], NONE)) != NONE:
                heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

        while heap:
            _, i, one, two = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or len(parts[i]) != one or j >= n or len(parts[j]) != two:
                continue  # one of the pair has changed since
            parts[i] += parts[j]
            parts[j], after[i] = None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [self.ranks[p] for p in parts if p is not None]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


class Remembered:
    """A dictionary of bounded size: what is asked for again moves to the newer half, the older half goes."""

    def __init__(self, half: int = REMEMBERED):
        self.half, self.new, self.old = half, {}, {}

    def get(self, key: str) -> tuple[int, ...] | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: tuple[int, ...]) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Tokenizer:
    """Splits texts by the pattern and remembers the stretches and words it has met.

    No match of the pattern reaches across a space that stands before another
    character than white space, so a text is first cut there, and the pattern runs
    on stretches not met before.
    """

    def __init__(self, path: str, pattern: str):
        self.encoder = TreeEncoder(read_ranks(path))
        # white space as Unicode has it; the regex module's \s holds more
        for short, name in ((r"[^\s", r"[^\p{White_Space}"), (r"\s", r"\p{White_Space}"), (r"\S", r"\P{White_Space}")):
            pattern = pattern.replace(short, name)
        self.split = regex.compile(pattern)
        self.decimal = {i: str(i) for i in self.encoder.tokens}
        self.words, self.known = Remembered(WORDS), Remembered()

    def word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            found = tuple(self.encoder.encode(word.encode()))
            if len(word) <= 64:
                self.words.put(word, found)
        return found

    def stretch(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch not among the newer ones."""
        found = self.known.get(stretch)
        if found is None:
            found = tuple(i for word in self.split.findall(stretch) for i in self.word(word))
            if len(stretch) <= 64:
                self.known.put(stretch, found)
        return found

    def ids(self, text: str) -> list[int]:
        pieces, out, known = text.split(" "), [], self.known
        held = pieces[0]
        for piece in pieces[1:]:
            if piece and not piece[0].isspace():
                if held:
                    out += known.new.get(held) or self.stretch(held)
                held = " " + piece
            else:
                held += " " + piece
        if held:
            out += known.new.get(held) or self.stretch(held)
        return out

    def joined(self, ids: list[int]) -> str:
        return ",".join([self.decimal[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One tokenizer a Python worker; its vocabulary is read once."""
    return Tokenizer(path, pattern)


remembers(__name__, tokenizer.cache_clear)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every whole text.

    Null and empty texts give no tokens.  Rows are answered one by one, repeats
    too.  The digests are of the decimal ids joined by commas and of the bytes that
    the ids decode to; they are made where the tokens are.  ``path`` is the rank
    file, which every worker has as part of its Python.
    """

    def run(batch: pa.RecordBatch) -> dict:
        own = tokenizer(path, pattern)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for text in batch.column(1).to_pylist():
            ids = own.ids(text or "")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(own.joined(ids).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(own.encoder.decode(ids)).hexdigest())
            out["ids"].append(array("i", ids))
        out["ids"] = pa.array([np.frombuffer(x, np.int32) for x in out["ids"]], pa.list_(pa.int32()))
        return out | {"doc_id": batch.column(0)}

    rows = checked(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return per_batch(rows, "text", run, SCHEMA)
