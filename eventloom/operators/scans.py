"""Ordered folds and exact ranks over groups of any size.

A fold over a key's rows in order is taken in ranges of (key, order): within each range by a window, and
from range to range by one row for each key and range, so a key that holds a third of all rows is spread
over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values among which a percentile is looked up by their counts.
LOOKUP = 50_000
ACCURACY = 2_000


def scan(df: DataFrame, key: str, order: Sequence[str], out: dict[str, tuple[str, Column]], checkpoint: Callable[[DataFrame], DataFrame], parts: int | None = None) -> DataFrame:
    """df with folds of every key's rows by ascending, unique order columns.  out: name -> (fold, value):

    lag, lead  the value of the row before or after, null without one;
    last       the last value that isn't null, up to the row;
    sum, max   over the rows up to and including the row; max_before: over the rows before it.

    checkpoint(df) writes and rereads a table; it fixes the ranges."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.withColumns({f"_v_{n}": v for n, (_, v) in out.items()})
    dealt = checkpoint(own.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    so_far, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    box = lambda n: F.struct(F.col(f"_v_{n}").alias("v"))  # noqa: E731  a null value is one as well
    within = {
        "lag": lambda n: F.lag(box(n)).over(inside), "lead": lambda n: F.lead(box(n)).over(inside), "last": lambda n: F.last(f"_v_{n}", ignorenulls=True).over(so_far),
        "sum": lambda n: F.sum(f"_v_{n}").over(so_far), "max": lambda n: F.max(f"_v_{n}").over(so_far), "max_before": lambda n: F.max(f"_v_{n}").over(before),
    }
    whole = {
        "lag": lambda n: F.max_by(box(n), place), "lead": lambda n: F.min_by(box(n), place), "last": lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)),
        "sum": lambda n: F.sum(f"_v_{n}"), "max": lambda n: F.max(f"_v_{n}"), "max_before": lambda n: F.max(f"_v_{n}"),
    }
    ranges = dealt.groupBy(key, "_range").agg(*(whole[f](n).alias(f"_w_{n}") for n, (f, _) in out.items()))
    by = Window.partitionBy(key).orderBy("_range")  # no more rows than ranges
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    across = {
        "lag": lambda n: F.lag(f"_w_{n}").over(by), "lead": lambda n: F.lead(f"_w_{n}").over(by), "last": lambda n: F.last(f"_w_{n}", ignorenulls=True).over(earlier),
        "sum": lambda n: F.sum(f"_w_{n}").over(earlier), "max": lambda n: F.max(f"_w_{n}").over(earlier), "max_before": lambda n: F.max(f"_w_{n}").over(earlier),
    }
    carried = ranges.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), *(across[f](n).alias(f"_c_{n}") for n, (f, _) in out.items()))
    rows = dealt.withColumns({f"_i_{n}": within[f](n) for n, (f, _) in out.items()})
    rows = rows.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))

    def value(name: str, fold: str) -> Column:
        i, c = F.col(f"_i_{name}"), F.col(f"_c_{name}")
        if fold in ("lag", "lead"):
            return F.coalesce(i, c)["v"]
        if fold == "last":
            return F.coalesce(i, c)
        if fold == "sum":
            return F.when(i.isNotNull() | c.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
        return F.greatest(i, c)

    return rows.select(*df.columns, *(value(n, f).alias(n) for n, (f, _) in out.items()))


def as_of(versions: DataFrame, probes: DataFrame, key: str, start: str, at: str, checkpoint: Callable[[DataFrame], DataFrame], tie: str | None = None) -> DataFrame:
    """Probes with the last version of their key that starts at or before their time (columns of versions
    beside key; start as it is called there), null without one.

    Versions and probes are put in one order and the last version is carried on, so a key's versions times
    its probes are never made.  tie orders versions of one start."""
    held = [c for c in versions.columns if c != key]
    asks = [c for c in probes.columns if c != key]
    empty = F.lit(None)
    v = versions.select(key, F.col(start).alias("_at"), F.lit(0).alias("_asks"), (F.col(tie).cast("string") if tie else F.lit("")).alias("_tie"), F.struct(*held).alias("_version"), empty.alias("_probe"))
    p = probes.select(key, F.col(at).alias("_at"), F.lit(1).alias("_asks"), F.monotonically_increasing_id().cast("string").alias("_tie"), empty.alias("_version"), F.struct(*asks).alias("_probe"))
    both = v.unionByName(p)
    found = scan(both, key, ["_at", "_asks", "_tie"], {"_held": ("last", F.col("_version"))}, checkpoint).where("_asks = 1")
    return found.select(key, *(F.col(f"_probe.{c}").alias(c) for c in asks), *(F.col(f"_held.{c}").alias(c) for c in held))


def percentiles(df: DataFrame, key: str, value: str, shares: Sequence[float], checkpoint: Callable[[DataFrame], DataFrame], lookup: int = LOOKUP) -> DataFrame:
    """(key, share, value): the nearest-rank percentiles of each group, exactly: the least value that a share of
    the group's values, nulls apart, doesn't exceed.

    A quantile sketch of fixed size brackets each rank, a pass counts what lies below and in the bracket, and
    brackets are narrowed until at most ``lookup`` distinct values are in any; then their counts tell."""
    own = df.select(F.col(key).alias("k"), F.col(value).alias("v")).where("v IS NOT NULL")
    asked = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    sizes = own.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = sizes.select("k", asked.alias("share"), "n", "lo", "hi").withColumn("rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("share") * F.col("n") - 1e-9).cast("long")))
    state = checkpoint(state.withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")}))
    for _ in range(8):
        if state.where(F.col("inside") > lookup).isEmpty():
            break
        wide = state.where(F.col("inside") > lookup)
        rows = own.join(wide, own.k.eqNullSafe(wide.k)).where("v BETWEEN lo AND hi").select(wide.k, "share", "v", "rank", "below", "inside")
        near = lambda d: F.least(F.greatest((F.col("rank") - F.col("below")) / F.col("inside") + d * 2.0 / ACCURACY, F.lit(0.0)), F.lit(1.0))
        # the sketch gives all of its steps, of which the two around the rank are taken
        steps = [i / 500 for i in range(501)]
        sketch = rows.groupBy("k", "share").agg(F.percentile_approx("v", steps, ACCURACY * 5).alias("q"), F.first("rank").alias("rank"), F.first("below").alias("below"), F.first("inside").alias("inside"))
        lo = F.element_at("q", F.greatest(F.floor(near(-1) * 500).cast("int"), F.lit(1)))
        hi = F.element_at("q", F.least(F.ceil(near(1) * 500).cast("int") + 2, F.lit(501)))
        cut = sketch.select(F.col("k").alias("k2"), F.col("share").alias("s2"), lo.alias("lo2"), hi.alias("hi2"))
        state = state.join(cut, state.k.eqNullSafe(F.col("k2")) & (F.col("share") == F.col("s2")), "left")
        state = state.select("k", "share", "n", "rank", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"))
        bounds = state.select(F.col("k").alias("k3"), "share", "lo", "hi")
        counted = own.join(bounds, own.k.eqNullSafe(F.col("k3"))).groupBy("k3", "share").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.approx_count_distinct(F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.col("v"))).alias("values"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("rows"))
        # what counts is how many values a bracket has: a value that is repeated without end is one row
        counted = counted.select("k3", F.col("share").alias("s3"), "below", F.when(F.col("values") * 2 < lookup, F.least(F.col("rows"), F.lit(lookup))).otherwise(F.col("rows")).alias("inside"))
        state = checkpoint(state.join(counted, state.k.eqNullSafe(F.col("k3")) & (F.col("share") == F.col("s3"))).select("k", "share", "n", "lo", "hi", "rank", "below", "inside"))
    bounds = state.select(F.col("k").alias("k4"), "share", "lo", "hi", "rank", "below")
    counts = own.join(bounds, own.k.eqNullSafe(F.col("k4"))).where("v BETWEEN lo AND hi").groupBy("k4", "share", "v").agg(F.count("*").alias("c"), F.first("rank").alias("rank"), F.first("below").alias("below"))
    ahead = F.sum("c").over(Window.partitionBy("k4", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    found = counts.withColumn("ahead", ahead).where("ahead >= rank").groupBy("k4", "share").agg(F.min("v").alias("v"))
    return found.select(F.col("k4").alias(key), "share", F.col("v").alias(value))
