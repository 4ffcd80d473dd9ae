"""Fill-in-middle documents by displacement scatter.

A text is cut into prefix, middle and suffix, which swap places between markers.
Where each byte goes is never copied piece by piece: the cuts are scanned to byte
positions, every piece gets one shift (its place in the output less its place in
the input), the shifts enter a difference array over the bytes of the whole batch,
and its running sum says for each byte how far it moves; one scatter builds all
outputs of the batch.  Restoring reads form and markers of the outputs, builds the
difference array over the restored bytes and gathers.

Both run over windows of bounded bytes, with the running sum carried on, so a very
long text needs little beyond itself.  No row needs another: there is no shuffle.

Null and empty texts give the plain form of the empty text.  A null doc_id counts
as an empty decimal.  Rows that repeat give equal rows, ties do not arise, an empty
table gives an empty result, and further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import buffer_of, checked, per_batch

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = 3
WINDOW = 1 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 that depend on seed and id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def planned(docs: DataFrame, seed: int, fim_percent: int, spm_percent: int) -> DataFrame:
    """doc_id, text, n, form and the code points of prefix and middle; null lengths in the plain form."""
    first, second, chance, order = draws("doc_id", seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = checked(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), F.char_length(text).cast("long").alias("n"),
        first.alias("h1"), second.alias("h2"), chance.alias("h3"), order.alias("h4"),
    )
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (
        F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= fim_percent), PLAIN)
        .when(F.col("h4") % 100 < spm_percent, SPM)
        .otherwise(PSM)
    )
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    moved = F.col("form") != PLAIN
    return rows.withColumn("form", form).select(
        "doc_id", "text", "n", "form",
        F.when(moved, F.least(a, b)).alias("prefix_chars"),
        F.when(moved, F.greatest(a, b) - F.least(a, b)).alias("middle_chars"),
    )


def _starts(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


def points_before(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte position."""
    found, seen = np.zeros(len(positions), np.int64), 0
    for low in range(0, len(data), WINDOW):
        counts = np.concatenate([[0], np.cumsum(_starts(data[low : low + WINDOW]))])
        here = (positions >= low) & (positions < low + len(counts))
        found[here] = seen + counts[positions[here] - low]
        seen += int(counts[-1])
    return found


def byte_of(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Byte position at which each code point of the batch begins; the number after the last is the end."""
    found, seen = np.full(len(points), len(data), np.int64), 0
    for low in range(0, len(data), WINDOW):
        at = np.flatnonzero(_starts(data[low : low + WINDOW]))
        here = (points >= seen) & (points < seen + len(at))
        found[here] = low + at[points[here] - seen]
        seen += len(at)
    return found


def shifts(size: int, begins: np.ndarray, shift: np.ndarray):
    """(low, high, shift of each byte) window by window, from the shifts of pieces in the order of ``begins``.

    The differences of consecutive shifts are added where pieces begin; pieces
    without bytes begin where their successor does and leave no trace in the sum.
    """
    change = np.diff(shift, prepend=0)
    carry = 0
    for low in range(0, size, WINDOW):
        high = min(size, low + WINDOW)
        first, last = np.searchsorted(begins, [low, high])
        array = np.zeros(high - low, np.int64)
        np.add.at(array, begins[first:last] - low, change[first:last])
        array = carry + np.cumsum(array)
        carry = int(array[-1])
        yield low, high, array


def _layout(form: np.ndarray, prefix: np.ndarray, middle: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where prefix, middle and suffix begin in each output, and the three markers, relative to its start."""
    spm, moved = form == SPM, form != PLAIN
    p = np.where(spm, 2 * MARK + suffix, MARK)
    m = 3 * MARK + prefix + suffix
    s = np.where(spm, MARK, 2 * MARK + prefix)
    return tuple(np.where(moved, x, y) for x, y in ((p, 0), (m, prefix), (s, prefix + middle)))


def scatter(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray):
    """Bytes and offsets of the outputs of a batch."""
    moved = form != PLAIN
    first = points_before(data, offsets[:-1])
    cut_a = np.where(moved, byte_of(data, first + prefix), offsets[1:])
    cut_b = np.where(moved, byte_of(data, first + prefix + middle), offsets[1:])
    pieces = np.stack([offsets[:-1], cut_a, cut_b], 1)
    p, m, s = _layout(form, cut_a - offsets[:-1], cut_b - cut_a, offsets[1:] - cut_b)
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) + 3 * MARK * moved)])
    places = np.stack([p, m, s], 1) + ends[:-1, None]
    out = np.empty(ends[-1], np.uint8)
    for low, high, shift in shifts(len(data), pieces.ravel(), (places - pieces).ravel()):
        out[np.arange(low, high) + shift] = data[low:high]
    for k, name in enumerate((PREFIX, MIDDLE, SUFFIX)):
        out[(places[moved, k] - MARK)[:, None] + np.arange(MARK)] = np.frombuffer(name.encode(), np.uint8)
    return out, ends


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray):
    """Bytes and offsets of the texts, rebuilt from outputs and forms."""
    moved = np.flatnonzero(form != PLAIN)
    names = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)[1::MARK]
    marks = []
    for low in range(0, len(data), WINDOW):
        x = data[low : low + WINDOW + MARK - 1]
        at = low + np.flatnonzero((x[:-2] == 60) & (x[2:] == 62) & np.isin(x[1:-1], names))
        marks.append(at)
    marks = np.concatenate(marks) if marks else np.empty(0, np.int64)
    row = np.searchsorted(offsets, marks, "right") - 1
    marks = marks[(form[row] != PLAIN) & (marks + MARK <= offsets[row + 1])]
    if len(marks) != 3 * len(moved):
        raise ValueError("an output does not have its three markers")
    marks = marks.reshape(-1, 3)
    order = np.where((form[moved] == SPM)[:, None], [1, 2, 0], [0, 2, 1])  # of prefix, middle, suffix
    bounds = np.concatenate([marks, offsets[moved + 1][:, None]], 1)
    source = np.repeat(offsets[:-1, None], 3, 1)
    length = np.zeros((len(form), 3), np.int64)
    length[:, 0] = np.diff(offsets)
    source[moved] = np.take_along_axis(marks + MARK, order, 1)
    length[moved] = np.take_along_axis(bounds[:, 1:] - marks - MARK, order, 1)
    ends = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(ends[-1], np.uint8)
    for low, high, shift in shifts(len(out), ends[:-1], source.ravel() - ends[:-1]):
        out[low:high] = data[np.arange(low, high) + shift]
    return out, ends[::3]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


KEPT = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
KEPT_SCHEMA = "n long, form string, prefix_chars long, middle_chars long"


def transform(docs: DataFrame, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    The cuts are code points; the sha256 of seed and doc_id fixes them, the form
    and the order.  A text that holds a marker stays plain, so markers in an output
    of another form are unambiguous.
    """
    rows = planned(docs, seed, fim_percent, spm_percent)

    def build(batch: pa.RecordBatch) -> dict:
        form = np.array(batch.column("form").to_pylist(), object)
        built = scatter(
            *buffer_of(batch.column("text")), form, _numbers(batch.column("prefix_chars")), _numbers(batch.column("middle_chars"))
        )
        return {c: batch.column(c) for c in KEPT} | {"output": _strings(*built)}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return per_batch(rows, "text", build, f"doc_id {kind}, {KEPT_SCHEMA}, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """The rows of :func:`transform` with ``restored``, the text rebuilt from output and form alone."""
    kind = outputs.schema["doc_id"].dataType.simpleString()

    def rebuild(batch: pa.RecordBatch) -> dict:
        form = np.array(batch.column("form").to_pylist(), object)
        kept = {c: batch.column(c) for c in (*KEPT, "output")}
        return kept | {"restored": _strings(*gather(*buffer_of(batch.column("output")), form))}

    rows = checked(outputs, *KEPT, "output")
    return per_batch(rows, "output", rebuild, f"doc_id {kind}, {KEPT_SCHEMA}, output string, restored string")


def digests(docs: DataFrame) -> DataFrame:
    """Form and lengths of every row with the digests of output and restored text."""
    return restore(transform(docs)).select(
        *KEPT, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )
