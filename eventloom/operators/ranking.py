"""Order-dependent selection: first per key, coverage, interleaving, round-robin, versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from . import scans
from .scans import scan
from .search import ranked


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ascending columns, by aggregation: a hot key is combined per task.

    order must end in a column that is unique within a key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*(c if c in keys else F.col(f"best.{c}").alias(c) for c in df.columns))


def price_order(price: str, key: str) -> Column:
    """Dearest first, unknown prices last, ties by key: one ascending column."""
    return F.struct(F.col(price).isNull().alias("n"), (-F.col(price)).alias("p"), F.col(key).alias("k"))


def ranks_of(chosen: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """A few chosen rows with their rank from 1 among all rows by an ascending, unique column of both.

    Every row is counted at the first chosen row that isn't ahead of it, so that no more than one count for
    each chosen row leaves a task and nothing is put in order."""
    cuts = chosen.agg(F.collect_list(order).alias("cuts"))  # one row of a few values
    at = F.array_min(F.filter("cuts", lambda c: c >= F.col(order)))
    counts = rows.select(order).crossJoin(F.broadcast(cuts)).groupBy(at.alias("at")).agg(F.count("*").alias("rows")).where("at IS NOT NULL")
    ranks = chosen.select(F.col(order).alias("own")).join(F.broadcast(counts), F.col("at") <= F.col("own")).groupBy("own").agg(F.sum("rows").alias("rank"))
    return chosen.join(ranks, F.col(order) == F.col("own")).drop("own")


def category_coverage(ranked: DataFrame, category: str, production: str, k: int) -> DataFrame:
    """First of each category in rank order, then the best of the remaining productions, as many as k.

    ranked has a column rank, of any type that can be ordered.  One row per production comes first, so that k * 2 rows reach the end."""
    once = first_per_key(ranked, [production], ["rank"])
    heads = once.groupBy(category).agg(F.min("rank").alias("head"))
    marked = once.join(heads, category).withColumn("later", (F.col("rank") != F.col("head")).cast("int"))
    return marked.orderBy("later", "rank").limit(k).drop("head", "later")


def interleave(df: DataFrame, first: Sequence[Column], second: Sequence[Column], key: str, k: int) -> DataFrame:
    """(key, position): two orders dealt in turn, each key once at its earlier place, as many as k.

    Of each order the first k rows are enough, since a key drops at most once from either."""
    a = df.orderBy(*first).limit(2 * k).withColumn("position", 2 * F.row_number().over(Window.orderBy(*first)) - 1)
    b = df.orderBy(*second).limit(2 * k).withColumn("position", 2 * F.row_number().over(Window.orderBy(*second)))
    both = a.select(key, "position").unionByName(b.select(key, "position"))
    return both.groupBy(key).agg(F.min("position").alias("position")).orderBy("position").limit(k)


def interleave_unique(df: DataFrame, first: Sequence[Column], second: Sequence[Column], id_col: str, uniques: Sequence[str], k: int, checkpoint=cut, max_rounds: int = 1000) -> DataFrame:
    """(id, position): two orders dealt in turn, as many as k; a row is passed over if one that was taken has the same value in
    any of the unique columns (production, then show).

    Rows that are the first of all their values are taken at once, what shares a value with them goes, and so
    on: the same rows as one by one, in a few rounds of aggregations.  Orders must end in a unique key."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = ranked(df, first, parts, checkpoint).select(id_col, *uniques, (2 * F.col("rank") - 1).alias("position"))
    two = ranked(df, second, parts, checkpoint).select(id_col, *uniques, (2 * F.col("rank")).alias("position"))
    left = checkpoint(one.unionByName(two).groupBy(id_col, *uniques).agg(F.min("position").alias("position")))
    taken = checkpoint(left.where("false"))
    for _ in range(max_rounds):
        heads = left
        for c in uniques:
            heads = heads.join(left.groupBy(F.col(c).alias("_c")).agg(F.min("position").alias("_p")), F.col(c).eqNullSafe(F.col("_c"))).where("position = _p").drop("_c", "_p")
        heads = checkpoint(heads.select(*left.columns))
        taken = checkpoint(taken.unionByName(heads).orderBy("position").limit(k))  # later rounds may still bring earlier ones
        for c in uniques:
            left = left.join(heads.select(F.col(c).alias("_c")).distinct(), F.col(c).eqNullSafe(F.col("_c")), "left_anti")
        last = taken.agg(F.count("*").alias("n"), F.max("position").alias("p")).first()
        left = checkpoint(left.where(F.col("position") < last["p"]) if last["n"] == k else left)
        if left.isEmpty():
            return taken.select(id_col, "position")
    raise RuntimeError("the interleaving did not settle")


def fair_round_robin(df: DataFrame, source: str, order: Sequence[Column], turns: int) -> DataFrame:
    """The first ``turns`` rows of every source with their turn, for taking sources in rotation.

    Spark keeps only the first rows of each source in every task before they are shuffled."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= turns)


def version_intervals(df: DataFrame, key: str, start: str, content: Sequence[str], tie: str, checkpoint=cut) -> DataFrame:
    """[start, end) of each version of a key; a version that equals the one before is no new version."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256)
    order = list(dict.fromkeys([start, tie]))
    seen = scan(df.withColumn("_h", digest), key, order, {"_p": ("lag", F.col("_h"))}, checkpoint)
    changed = seen.where("_p IS NULL OR _h != _p").drop("_h", "_p")
    return scan(changed, key, order, {"end": ("lead", F.col(start))}, checkpoint)


def as_of(versions: DataFrame, probes: DataFrame, key: str, start: str, end: str, at: str, checkpoint=cut) -> DataFrame:
    """Probes with the version that holds at their time; those without one are left out."""
    found = scans.as_of(versions, probes, key, start, at, checkpoint)
    return found.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def latest_wins(df: DataFrame, keys: Sequence[str], clock: str, tie: str) -> DataFrame:
    """The row with the latest clock of each key, the greatest tie among equals."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(clock, tie)).alias("best"))
    return best.select(*(c if c in keys else F.col(f"best.{c}").alias(c) for c in df.columns))


def reconcile(old: DataFrame, new: DataFrame, key: str, scope: str, order: str) -> DataFrame:
    """Snapshot update: what new rows' scopes hold replaces the old, other scopes are carried over, and of
    several rows of a key the last by order wins."""
    carried = old.join(new.select(scope).distinct(), scope, "left_anti")
    return latest_wins(carried.select(*old.columns).unionByName(new.select(*old.columns)), [key], order, scope)
