"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.spool import spool


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Every node's neighbours (the larger or the smaller ones) move to its smallest neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = near.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        inner = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = inner.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest node that can be reached.

    Null ends and links of a node to itself are left out. Every round is written to the shared
    folder, so lineage stays short; the number of rounds grows with the logarithm of the links.
    """
    edges = (
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("_two"))
        .filter("_two").select("u", "v").distinct()
    )
    edges = spool(edges, "links").df
    state = None
    while True:
        edges = spool(_star(spool(_star(edges, True), "large").df, False), "small").df
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(row)
