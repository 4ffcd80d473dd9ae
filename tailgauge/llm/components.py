"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its least node.

    ``edges`` has two columns of one orderable type; loops, nulls and repeats are
    ignored.  Alternates between linking each node's larger neighbours and then
    its smaller ones to its least neighbour until nothing changes (a logarithmic
    number of rounds in practice).  Each round aggregates minima, which tasks
    combine before the shuffle, so a node with very many neighbours is no large
    group; each round's edges are a written table.  No edges give an empty table.
    """
    a, b = edges.columns
    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), label
    )
    before = None
    while True:
        # larger neighbours of u are linked to u's least neighbour
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, label)
        # u and its smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        current = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = labels.select("component").distinct().select(F.col("component").alias("node"), "component")
    return labels.unionByName(roots)
