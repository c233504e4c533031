"""Connected components over an edge table, as alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_parts

#: Bytes of an edge, where sizes of tables are reckoned.
EDGE_BYTES = 32


def _star(edges: DataFrame, large: bool, size: int) -> DataFrame:
    """One step on edges (u > v).

    Large star: every node hands its larger neighbours to its smallest one. Small star: it hands its
    smaller ones, and itself. The minimum is a plain aggregate, so a node with very many neighbours is combined
    before the shuffle. It becomes a table of its own: between two plain shuffles AQE can split the node's edges in the
    join, with an aggregate behind one of them it can't. What is joined goes on in parts of a checked size.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), size)
        out = in_parts(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), size)
    else:
        least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")), size)
        out = in_parts(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), size)
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _loose(edges: DataFrame, size: int) -> tuple[int, int]:
    """How many edges (u > v) there are, and how many nodes have two smaller neighbours or neighbours on both sides.

    Without such nodes all edges end in the smallest node of their component.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    nodes = in_parts(ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")), size)
    return tuple(nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0)))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Empty input gives an empty table. The loop ends when all components are stars; that takes a number
    of rounds logarithmic in the longest path. Each step is checkpointed: a lost executor costs one step at most, and
    no step is run again for the next one.
    """
    size = edges.count() * EDGE_BYTES
    now = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), size)
    count, loose = _loose(now, size)
    while loose:
        size = 2 * count * EDGE_BYTES
        for large in (True, False):
            now = checkpointed(_star(now, large, size), size)
        count, loose = _loose(now, size)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
