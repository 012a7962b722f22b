"""Connected components by alternating large-star and small-star steps.

Each round is two shuffles of the edge table (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  No neighbourhood is collected: a
node's least neighbour comes from a partial aggregate and is joined back, so a
hub's edges can lie in many tasks (skewed joins are split at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import discard, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v): to each node's least neighbour or the node itself."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        return both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for nodes that have an edge.

    Edges with a null end or two equal ends are ignored; an empty edge table
    gives an empty result.  Ends must be integers.
    """
    now = materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v").distinct(), "edges")
    sign = None
    while True:
        following = materialize(_stars(_stars(now, True), False), "edges")
        discard(now)
        now = following
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == sign or row[0] == 0:
            break
        sign = tuple(row)
    # Stable: every edge leads from a node to its component's least node.
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
