"""Sharding by histogram sort: shards of near-equal bytes in the order of a key.

The key is (crc32 of the text, doc_id), so equal texts are neighbours.  The seven
splitters are found by counting: each round sums the exact bytes of all rows in
the cells between candidate boundaries, cell by cell and combined in every task,
then keeps for each splitter the cell that holds its target and cuts that cell
again.  A boundary whose bytes below are within ``tolerance`` of a shard from the
target is taken as it is.  First the checksum is refined, then, where one text's
copies outweigh the tolerance, the ids.  Only the small table of keys and sizes is
read in these rounds.  With the splitters known, the documents with all their
columns are exchanged once and written, one folder for each shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .columns import checked

#: Cells into which a round cuts the cell that holds a target.
CELLS = 1 << 10


@dataclass(frozen=True)
class Splitter:
    """Rows at or above (crc, id) lie right of it; ``below`` are the exact bytes left of it."""

    crc: int
    id: int | None
    below: int


#: What a row gets; columns of these names in the input are replaced.
GIVEN = ("size", "text_crc32", "shard", "slot")


def bytes_of(text: str) -> tuple[Column, Column]:
    """Bytes with the end, and checksum of a text; null texts have no bytes."""
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")


def order_id(doc_id: str) -> Column:
    """The id by which copies are ordered; null ids come first."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id")


def keys(docs: DataFrame) -> DataFrame:
    """(size, text_crc32, id) of every row."""
    return checked(docs, "doc_id", "text").select(*bytes_of("text"), order_id("doc_id"))


def cell_bytes(table: DataFrame, cell: Column) -> dict[int, int]:
    """Exact bytes of every cell; a round has at most CELLS for each splitter."""
    got = table.groupBy(cell.cast("long").alias("cell")).agg(F.sum("size").alias("bytes")).collect()
    return {r["cell"]: r["bytes"] for r in got}


def splitters(table: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """The boundaries between ``shards`` shards of near-equal bytes.

    Bytes below a boundary are within ``tolerance`` shards of the target, or as
    near as whole rows allow.
    """
    total = table.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    allowed = tolerance * total / shards
    done: dict[int, Splitter] = {}
    # the open cell of each target: first value and bytes below it
    cells = {k: (0, 0) for k in range(len(targets))}
    bits = CELLS.bit_length() - 1
    shift = 32
    while shift > 0 and cells:
        step = min(bits, shift)
        before, shift = shift, shift - step
        opened = table
        if before < 32:
            opened = table.where(F.shiftright("text_crc32", before).isin([low >> before for low, _ in cells.values()]))
        counts = cell_bytes(opened, F.shiftright("text_crc32", shift))
        for k, (low, below) in list(cells.items()):
            first = low >> shift
            for c in range(first, first + (1 << step)):
                here = counts.get(c, 0)
                if here and below + here > targets[k]:
                    break
                below += here
            else:
                here = 0
            start, after = c << shift, below + here
            near = min((abs(below - targets[k]), start, below), (abs(after - targets[k]), (c + 1) << shift, after))
            if near[0] <= allowed or not here:
                done[k] = Splitter(near[1], None, near[2])
                del cells[k]
            else:
                cells[k] = (start, below)
    for k, (crc, below) in cells.items():
        done[k] = by_id(table.where(F.col("text_crc32") == crc), crc, below, targets[k], allowed)
    return [done[k] for k in range(len(targets))]


def by_id(copies: DataFrame, crc: int, below: int, target: int, allowed: float) -> Splitter:
    """A boundary among the rows of one checksum, refined over their ids."""
    low, high = copies.agg(F.min("id"), F.max("id")).first()
    high += 1
    start = low
    while True:
        width = max(1, -(-(high - start) // CELLS))
        # the id range may exceed a long, so the difference is taken in decimals
        away = F.col("id").cast("decimal(38,0)") - F.lit(start).cast("decimal(38,0)")
        cell_of = F.floor(away / F.lit(width).cast("decimal(20,0)"))
        counts = cell_bytes(copies.where(f"id >= {start} AND id < {high}"), cell_of)
        here = cell = 0
        for cell in sorted(counts):
            here = counts[cell]
            if below + here > target:
                break
            below += here
        else:
            return Splitter(crc + 1, None, below)
        first, after = start + cell * width, start + (cell + 1) * width
        choices = [(abs(below - target), first, below), (abs(below + here - target), after, below + here)]
        best = min(choices)
        if best[0] <= allowed or width == 1:
            return Splitter(crc, best[1], best[2])
        start, high = first, min(high, after)


def shard_of(found: list[Splitter]) -> Column:
    """The number of splitters at or below a row's key."""
    number = F.lit(0)
    for s in found:
        above = F.col("text_crc32") >= s.crc
        if s.id is not None:
            above = (F.col("text_crc32") > s.crc) | ((F.col("text_crc32") == s.crc) & (F.col("id") >= s.id))
        number = number + above.cast("int")
    return number


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """All columns of every row, read from the folder of its shard, with size, text_crc32, shard and slot.

    Shards follow the key order and hold near-equal bytes; slots count from 0
    without gaps in key order inside a shard.  Copies of a text share a shard
    unless they outweigh the tolerance there; then the ids divide them.  Rows of
    one text and id are ties: they stay in one shard, in any order.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    found = splitters(materialize(keys(docs), "shard-keys"), shards, tolerance)
    carried = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns if n not in GIVEN]).alias("doc"))
    dealt = carried.select("doc", bytes_of("doc.text")[1], order_id("doc.doc_id")).withColumn("shard", shard_of(found))
    # one exchange by ranges of the whole key: a shard spans many tasks, and a text's copies are split by id
    ordered = dealt.repartitionByRange("shard", "text_crc32", "id").sortWithinPartitions("shard", "text_crc32", "id")
    ordered = ordered.select("doc", F.monotonically_increasing_id().alias("place"), "shard")
    path = scratch_path(spark, "shards")
    ordered.write.mode("errorifexists").partitionBy("shard").parquet(path)
    ordered = spark.read.schema(ordered.schema).parquet(path).withColumn("part", F.shiftright("place", 33))
    runs = ordered.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = {}
    offsets = []
    # one row for each task and shard
    for r in sorted(runs.collect(), key=lambda r: (r["shard"], r["part"])):
        offsets.append((r["shard"], r["part"], before.get(r["shard"], 0) - r["first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    moved = spark.createDataFrame(offsets, "shard int, part long, shift long")
    placed = ordered.join(F.broadcast(moved), ["shard", "part"])
    return placed.select("doc.*", *bytes_of("doc.text"), "shard", (F.col("place") + F.col("shift")).alias("slot"))


def shard_report(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """The digests of the sharded documents."""
    return shard_documents(docs, shards, tolerance).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
