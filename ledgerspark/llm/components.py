"""Connected components of a link table, by alternating large and small stars.

Every step is an aggregate per node and a join with its result; the node side of the join is
unique, so a node with very many links is split at run time. No task sees a component whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges run from the larger to the smaller node. Large: a node's larger neighbours are
    linked with its least neighbour (or itself). Small: a node and its smaller neighbours are
    linked with the least of them."""
    if large:
        near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).select(F.col("a").alias("u"), "m")
        moved = near.join(least, F.col("a") == F.col("u")).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component``: the least node of its component, for nodes with a link to
    another node. Nodes are whole numbers; links without both ends are left out."""
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges, before = materialize(edges, "links"), None
    while True:
        edges = materialize(_star(_star(edges, True), False), "links")
        # The stars change nothing more once every edge leads straight to its component.
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now
