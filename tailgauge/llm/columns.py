"""Column names, row keys and batch helpers shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; anything else a table carries cannot clash with them."""
    missing = [n for n in names if n not in docs.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return docs.select(*[F.col(f"`{n}`") for n in names])


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(text: str) -> Column:
    """A 64-bit hash of the text, which with the id names a row's content."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its values; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column``, or a single longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = buffer_of(batch.column(at))[1][1:]
        start, before = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores as long as the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_memories: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """Name what a module keeps in a worker between tasks, so that other modules' tasks can let it go."""
    _memories[owner] = forget


def forget_others(owner: str) -> None:
    """Workers are used again by later stages: drop what earlier ones of other modules have kept."""
    others = [forget for name, forget in _memories.items() if name != owner]
    for forget in others:
        forget()
    if others:
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: freed memory stays with the process


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}_modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def per_batch(
    df: DataFrame, column: str, function: Callable[[pa.RecordBatch], dict], schema: str, most: int = 1 << 20
) -> DataFrame:
    """Apply ``function`` to slices of bounded bytes; it returns the columns of ``schema`` by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    ship(df.sparkSession)

    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        for part in slices(batches, column, most):
            found = function(part)
            yield pa.RecordBatch.from_arrays(
                [
                    found[f.name].cast(f.type) if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, kind)
