"""Constrained clustering: edges are taken in order, two clusters join unless that would be a conflict.

The result is that of the sequential process (edges by priority, then ids), reached in rounds that work on
all clusters at once.  Every cluster points to the other end of its first live edge; the pointers form
trees whose edges come later the deeper they are, so a tree grows from its root in order of rank.  What
a tree takes before (a) the first edge that leaves it and (b) the first of its nodes that conflicts with
an earlier one is exactly what the sequential process takes, and is merged at once.  Edges between
clusters that conflict are dropped, all of them together: a conflict never goes away.

Conflicts are sets of keys of a cluster: an exclusive key may have one value in it, a unique value may
come once.  Each round is joins and aggregations of clusters and edges, so no component, however
large, is gathered in a task.  A round keeps what still has edges, and its tables go when the next has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop
from .joins import dealt

#: Pointers are followed to this power of two in a round; deeper nodes wait for the next.
JUMPS = 3


def _live(edges: DataFrame) -> DataFrame:
    """(x, y, rank) with x < y, the first edge of each pair."""
    own = edges.where("a != b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.struct(F.col("priority").cast("long").alias("priority")).alias("rank"))
    return own.groupBy("x", "y").agg(F.min("rank").alias("rank"))


def _ranked(live: DataFrame) -> DataFrame:
    """The edges with a number for a rank: its order is that of priority, least id and greatest id."""
    return live.orderBy("rank", "x", "y").select("x", "y", F.monotonically_increasing_id().alias("rank"))


def _key_sets(held: DataFrame) -> DataFrame:
    """(cluster, values, once): a map of exclusive keys and the unique values of each cluster."""
    pair = F.struct("key", "value")
    return held.groupBy("cluster").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), pair))).alias("values"), F.collect_list(F.when(F.col("value").isNull(), F.col("key"))).alias("once")
    )


def _without_conflicts(live: DataFrame, held: DataFrame, pairs: DataFrame | None) -> DataFrame:
    sets = _key_sets(held)
    side = lambda c: sets.select(F.col("cluster").alias(c), F.col("values").alias(f"v{c}"), F.col("once").alias(f"o{c}"))
    both = dealt(dealt(live, side("x"), "x", "left"), side("y"), "y", "left")
    differs = F.exists(F.map_keys("vx"), lambda k: F.try_element_at("vx", k) != F.try_element_at("vy", k))
    bad = F.coalesce(differs, F.lit(False)) | F.coalesce(F.arrays_overlap("ox", "oy"), F.lit(False))
    kept = both.where(~bad).select("x", "y", "rank")
    return kept if pairs is None else dealt(kept, pairs, ["x", "y"], "left_anti")


def _pointers(live: DataFrame) -> DataFrame:
    """(x, to, r): the other end and the rank of the first edge of every cluster."""
    both = live.select("x", "y", "rank").unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y"), "rank"))
    return both.groupBy("x").agg(F.min_by("y", "rank").alias("to"), F.min("rank").alias("r"))


def _trees(live: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], first: DataFrame | None = None) -> DataFrame:
    """(x, root, r): the clusters whose pointers (first) reach a root in 2 ** JUMPS steps; r is the rank of a
    cluster's pointer, null at the root."""
    first = checkpoint(_pointers(live)) if first is None else first
    mine = dealt(first, first.select(F.col("x").alias("to"), F.col("to").alias("back")), "to")
    ends, root = F.col("back") == F.col("x"), F.least("x", "to")
    at = mine.select("x", F.when(ends, root).otherwise(F.col("to")).alias("to"), F.when(~(ends & (root == F.col("x"))), F.col("r")).alias("r"), ends.alias("done"))
    at = start = checkpoint(at)
    for _ in range(JUMPS):
        on = at.select(F.col("x").alias("to"), F.col("to").alias("far"), F.col("done").alias("far_done"))
        at = dealt(at, on, "to").select("x", F.when(F.col("done"), F.col("to")).otherwise(F.col("far")).alias("to"), "r", (F.col("done") | F.col("far_done")).alias("done"))
    found = checkpoint(at.where("done").select("x", F.col("to").alias("root"), "r"))
    drop(start)
    return found


def _taken(trees: DataFrame, live: DataFrame, held: DataFrame, pairs: DataFrame | None, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(x, root) of the clusters that join their root in this round."""
    side = lambda c: trees.select(F.col("x").alias(c), F.col("root").alias(f"root_{c}"))
    across = dealt(dealt(live, side("x"), "x", "left"), side("y"), "y", "left").where("root_x IS DISTINCT FROM root_y")
    leaves = across.select(F.explode(F.array("root_x", "root_y")).alias("root"), "rank").where("root IS NOT NULL").groupBy("root").agg(F.min("rank").alias("stop"))
    # what comes after a tree's first edge that leaves it is not taken, so its keys don't matter
    near = checkpoint(dealt(trees, leaves, "root", "left").where("r IS NULL OR stop IS NULL OR r < stop").select("x", "root", "r"))
    # the second place at which a key has another value, or a unique value comes again
    place = F.struct(F.col("r").isNotNull().alias("later"), "r")
    own = dealt(near, held, F.col("x") == F.col("cluster")).select("root", "key", "value", F.when(F.col("value").isNull(), F.col("x")).alias("one"), place.alias("place"))
    each = own.groupBy("root", "key", "value", "one").agg(F.min("place").alias("place"))
    lowest = each.groupBy("root", "key", F.col("value").isNull().alias("u")).agg(F.min("place").alias("low"))
    clash = dealt(each.withColumn("u", F.col("value").isNull()), lowest, ["root", "key", "u"]).where("place > low").select("root", F.col("place.r").alias("rank"))
    if pairs is not None:
        end = lambda c: near.select(F.col("x").alias(c), F.col("root").alias(f"root_{c}"), F.col("r").alias(f"r_{c}"))
        known = dealt(dealt(pairs, end("x"), "x"), end("y"), "y").where("root_x = root_y")
        clash = clash.unionByName(known.select(F.col("root_x").alias("root"), F.greatest("r_x", "r_y").alias("rank")))
    breaks = clash.groupBy("root").agg(F.min("rank").alias("clash"))
    ahead = dealt(near.where("r IS NOT NULL"), breaks, "root", "left")
    new = checkpoint(ahead.where("clash IS NULL OR r < clash").select("x", "root"))
    drop(near)
    return new


def _named(nodes: DataFrame, steps: list[DataFrame], checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, cluster) of the nodes: the least id of each cluster.  steps: (x, root) of each round; a cluster joins a root once,
    so together they hold no more rows than there are nodes, and the last are followed first."""
    up = None
    for new in reversed(steps):
        if up is None:
            up = new
            continue
        far = dealt(new, up.select(F.col("x").alias("root"), F.col("root").alias("far")), "root", "left")
        all_ = checkpoint(far.select("x", F.coalesce("far", "root").alias("root")).unionByName(up))
        drop(new, up)
        up = all_
    if up is None:
        return nodes.select("id", F.col("id").alias("cluster"))
    least = up.groupBy("root").agg(F.least("root", F.min("x")).alias("least"))
    known = dealt(up, least, "root").select(F.col("x").alias("id"), "least").unionByName(least.select(F.col("root").alias("id"), "least"))
    return dealt(nodes, known, "id", "left").select("id", F.coalesce("least", "id").alias("cluster"))


def constrained_clusters(
    nodes: DataFrame, edges: DataFrame, id_col: str, checkpoint: Callable[[DataFrame], DataFrame], exclusive: DataFrame | None = None, unique: DataFrame | None = None,
    conflicts: DataFrame | None = None, max_rounds: int = 500,
) -> DataFrame:
    """(id, cluster): the least id of the cluster of every node.

    edges: (a, b, priority), taken by priority, least id and greatest id.  exclusive: (id, key, value), clusters
    with two values of a key don't join; unique: (id, value), nor do two that both hold a value; conflicts:
    (a, b) that are never in one cluster.  The distinct keys of a cluster must be few (providers, not
    listings).  checkpoint(df) writes and rereads a table.  Nulls among ids, keys and values are left out.
    """
    link = nodes.schema[id_col].dataType
    live = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast(link).alias("a"), F.col("b").cast(link).alias("b"), "priority")
    parts = []
    if exclusive is not None:
        parts.append(exclusive.select(F.col(id_col).alias("cluster"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).where("key IS NOT NULL AND value IS NOT NULL"))
    if unique is not None:
        parts.append(unique.select(F.col(id_col).alias("cluster"), F.col("value").cast("string").alias("key"), F.lit(None).cast("string").alias("value")).where("key IS NOT NULL"))
    held = parts[0] if parts else nodes.where("false").select(F.col(id_col).alias("cluster"), F.lit("").alias("key"), F.lit("").alias("value"))
    for part in parts[1:]:
        held = held.unionByName(part)
    pairs = None
    if conflicts is not None:
        pairs = checkpoint(conflicts.where("a != b").select(F.least("a", "b").cast(link).alias("x"), F.greatest("a", "b").cast(link).alias("y")).distinct())
    held = checkpoint(held.distinct())
    ids = nodes.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    unique = checkpoint(_live(live))
    live = last = checkpoint(_ranked(unique))
    drop(unique)
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        live = checkpoint(_without_conflicts(live, held, pairs))
        drop(last)
        last = live
        if live.isEmpty():
            drop(held, pairs, live)
            return _named(ids, steps, checkpoint).select(F.col("id").alias(id_col), "cluster")
        first = checkpoint(_pointers(live))
        trees = _trees(live, checkpoint, first)
        new = _taken(trees, live, held, pairs, checkpoint)
        steps.append(new)
        # clusters that no edge is left of need no keys
        to = dealt(first.select("x"), new, "x", "left").select(F.col("x").alias("_x"), F.coalesce("root", "x").alias("_to"))

        def moved(df: DataFrame, column: str) -> DataFrame:
            own = dealt(df, new.select(F.col("x").alias(column), F.col("root").alias("_to")), column, "left")
            return own.withColumn(column, F.coalesce("_to", column)).drop("_to")

        def kept(df: DataFrame, column: str) -> DataFrame:
            return dealt(df, to, F.col(column) == F.col("_x")).withColumn(column, F.col("_to")).drop("_x", "_to")

        two = moved(moved(live, "x"), "y").where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "rank")
        live = two.groupBy("x", "y").agg(F.min("rank").alias("rank"))
        old = (held, pairs)
        held = checkpoint(kept(held, "cluster").select("cluster", "key", "value").distinct())
        if pairs is not None:
            pairs = checkpoint(kept(kept(pairs, "x"), "y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        drop(*old, first, trees)
    raise RuntimeError("clusters did not settle")
