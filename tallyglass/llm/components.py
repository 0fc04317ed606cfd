"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (with map-side combine) and a join back; nothing about the graph reaches
the driver but two sums that tell whether the last step changed anything. Each step is written to the
shared folder, so lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: link every neighbour above a node to the node's least; small: those below."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another: component is the least node reachable."""
    e = edges.where(F.col(a) != F.col(b))
    e = cut(e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _mark(e)
    while before[0]:
        e = cut(_star(cut(_star(e, True)), False))
        after = _mark(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
