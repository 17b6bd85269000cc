"""Entity resolution: blocks, candidate edges, components, representatives.

Candidates come from equi-joins on block keys; clusters under conflicts are in ``clusters``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance_metres


def block_pairs(df: DataFrame, keys: Sequence[str], id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of one block with id < id2; columns of the second row end in 2."""
    cols = [id_col, *keep]
    left = df.select(*keys, *cols)
    right = df.select(*keys, *(F.col(c).alias(f"{c}2") for c in cols))
    return left.join(right, list(keys)).where(F.col(id_col) < F.col(f"{id_col}2"))


def star_edges(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """(a, b): every id of a key with the key's least id; linear, however large a key is."""
    least = df.groupBy(key).agg(F.min(id_col).alias("b"))
    return df.join(least, key).where(F.col(id_col) != F.col("b")).select(F.col(id_col).alias("a"), "b").distinct()


def grid_pairs(df: DataFrame, id_col: str, lat: str, lon: str, metres: float) -> DataFrame:
    """(id, id2, metres) of points within a distance: one side is sent to the nine cells around it, so
    that the join is an equi-join on the cell.  Cells are as wide as the distance."""
    step = metres / 111_000.0
    wide = F.lit(step) / F.greatest(F.cos(F.radians(F.round(F.col(lat), 0))), F.lit(0.01))
    cell = df.select(id_col, lat, lon, F.floor(F.col(lat) / step).alias("cy"), F.floor(F.col(lon) / wide).alias("cx"), F.round(F.col(lat), 0).alias("band"))
    shifts = F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1)))
    around = cell.withColumn("s", F.explode(shifts))
    # the width of cells depends on the rounded latitude: the cell is taken in the neighbour's band
    near_lat = F.round((F.col("cy") + F.col("s.dy") + 0.5) * step, 0)
    bands = around.withColumn("band2", F.explode(F.array_distinct(F.array(near_lat, F.col("band")))))
    wide2 = F.lit(step) / F.greatest(F.cos(F.radians(F.col("band2"))), F.lit(0.01))
    sent = bands.select(
        F.col(id_col).alias(f"{id_col}2"), F.col(lat).alias("lat2"), F.col(lon).alias("lon2"), (F.col("cy") + F.col("s.dy")).alias("cy"),
        (F.floor(F.col(lon) / wide2) + F.col("s.dx")).alias("cx"), F.col("band2").alias("band"),
    )
    d = distance_metres(F.col(lat), F.col(lon), F.col("lat2"), F.col("lon2"))
    pairs = cell.join(sent.distinct(), ["cy", "cx", "band"]).where(F.col(id_col) < F.col(f"{id_col}2")).withColumn("metres", d)
    return pairs.where(F.col("metres") <= metres).select(id_col, f"{id_col}2", "metres").distinct()


def subset_extensions(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, id2): token sets that one other set extends by a single token, and only one does."""
    base = df.select(id_col, F.array_sort(F.array_distinct(tokens)).alias("t"))
    own = base.select(F.col(id_col), F.array_join("t", " ").alias("k"))
    drop = base.where("size(t) > 1").select(F.col(id_col).alias(f"{id_col}2"), "t", F.explode("t").alias("x"))
    drop = drop.select(f"{id_col}2", F.array_join(F.array_remove("t", F.col("x")), " ").alias("k"))
    # the longer sets are counted by what is left of them first, so equal sets don't multiply
    only = drop.groupBy("k").agg(F.count("*").alias("n"), F.min(f"{id_col}2").alias(f"{id_col}2")).where("n = 1")
    return own.join(only, "k").select(id_col, f"{id_col}2")


def components(edges: DataFrame, nodes: DataFrame, id_col: str, checkpoint, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least reachable id, for every node.  edges: (a, b).

    Every round takes the least label around a node and then the label of that label, which halves what
    is left of a path; checkpoint(df) cuts the lineage durably."""
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("label")).distinct())
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        near = labels.join(seen, labels.id == seen.a, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        up = near.select(F.col("id").alias("p"), F.col("label").alias("up"))
        new = checkpoint(near.join(up, near.label == up.p, "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        labels = new.select("id", "label")
        if new.where("old != label").isEmpty():
            return labels.select(F.col("id").alias(id_col), F.col("label").alias("component"))
    raise RuntimeError("components did not settle")


def quarantine(members: DataFrame, flagged: DataFrame, id_col: str, group: str, checkpoint) -> DataFrame:
    """(id, round): what is flagged (round 0), and whatever shares a group with it, and so on until nothing new comes.

    members: (id, group); flagged: (id).  Each round only takes up the groups of what was new in the last, so a
    group is opened once; ids of no group are kept if flagged."""
    new = checkpoint(flagged.select(id_col).where(F.col(id_col).isNotNull()).distinct())
    pairs = members.select(id_col, group).where(F.col(id_col).isNotNull() & F.col(group).isNotNull())
    closed = checkpoint(new.withColumn("round", F.lit(0)))
    opened = checkpoint(pairs.where("false").select(group))
    number = 0
    while not new.isEmpty():
        number += 1
        groups = checkpoint(pairs.join(new, id_col, "left_semi").select(group).distinct().join(opened, group, "left_anti"))
        new = checkpoint(pairs.join(groups, group, "left_semi").select(id_col).distinct().join(closed, id_col, "left_anti"))
        opened = checkpoint(opened.unionByName(groups))
        closed = checkpoint(closed.unionByName(new.withColumn("round", F.lit(number))))
    return closed


def agreement(value: Column, fallback) -> Column:
    """Aggregate: the one distinct value of a group, else the fallback."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(fallback)
