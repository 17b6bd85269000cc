"""Connected components as joins and aggregations.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step replaces edges by
edges to the smallest neighbour, so that each component ends as a star around its smallest node.
The minimum of a neighbourhood is a partial aggregation, and joining it back is an equi-join with
one row for each node on the small side, so a node with a third of all edges is pre-aggregated and
its join can be split by adaptive execution.  No group is collected, nothing but counts reach the
driver, and the edges of every round are a table in the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One step over edges (u > v).  Large: u's larger neighbours are linked to the least of u's
    neighbourhood; small: u's smaller neighbours and u are.  The least neighbours are a table of their
    own, so that the join has two plain exchanges and a hot node's edges can be split."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", 2 * rows)
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least", rows)
        out = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node is a root, or has one parent and no child: all components are stars."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of an edge table; component is its smallest reachable node.

    Nulls, loops and repeated edges don't count.  Nodes without an edge aren't listed.  rows is a bound on
    the number of edges where one is known.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(pairs.where("u != v").distinct(), "edges", rows)
    while not _is_forest(now):
        n = now.count()
        large = materialize(_star(now, True, n), "edges", n)
        now = materialize(_star(large, False, n), "edges", 2 * n)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
