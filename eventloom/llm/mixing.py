"""Mixing sources to target weights by Pareto order sampling (operator 3).

Targets.  Sources by code point, null last, weigh 5, 2, 1, repeating, and share 150 % of all words.
A target stops at twice its source's words, and the excess is reshared by weight: targets are
min(2 * size, weight * level) for one level, found by a few aggregations of the source table.

Inclusion.  Within a source a document of c words has expected copies min(2, rate * weight), where
weight falls slowly with its length (a step for each doubling), so long documents are chosen less
often than short ones; rate makes the expected words the target.  The whole part of the expected
copies is taken for certain.  The rest is an inclusion probability p: documents are ranked by their
random odds u / (1 - u) over their inclusion odds p / (1 - p) (Rosen's Pareto order sampling), u a hash
of doc_id and seed, and taken in this order while they come nearer to the target.

Scale.  Ranks are cut into buckets of rank / (1 + rank).  Words per source and bucket are a partial
aggregation, and running sums of at most ``BUCKETS`` rows a source find the bucket in which the
source's target is reached.  Only the documents of that one bucket are put in order, so no source, however
large, is sorted or gathered in a task.  A last document per source, the one that fits the rest best,
is found by an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT, MAX_COPIES = 150, 2
#: Factor of the inclusion weight for each doubling of a document's words.
LENGTH_FACTOR = 0.9
BUCKETS = 4096
SEED = 17


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a hash of the key, the same in every run."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48)


def _indexed(sources: DataFrame) -> DataFrame:
    """Sources with their place k in code point order, null last: sorted in ranges, each of which adds
    the number of rows of the ranges before it."""
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged-sources")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("at", place).join(before, "part").withColumn("k", F.col("at") + F.col("before")).drop("part", "at", "count", "before")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size): capped shares of the total."""
    weights = F.array(*map(F.lit, WEIGHTS))
    table = _indexed(sizes).withColumn("weight", F.element_at(weights, (F.col("k") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    table = materialize(table.select("key", "source_size", "weight"), "sources")
    cap = F.lit(float(MAX_COPIES)) * F.col("source_size")
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * TOTAL_PERCENT / 100
    level = 0.0
    while True:  # each turn caps at least one source more
        full = cap <= F.lit(level) * F.col("weight")
        rest = table.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if rest.weights is None:
            level = None
            break
        new = (total - (rest.capped or 0.0)) / rest.weights
        if new <= level:
            break
        level = new
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return table.select("key", "source_size", target.alias("target"))


def _expected(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, class, source_size, target, expected): copies of a document of each length class, capped at
    MAX_COPIES.  Classes are put in order of weight; the first are capped, as few as leave the others
    below the cap.  A source has at most 64 classes."""
    by_source = Window.partitionBy("key")
    t = classes.join(targets, "key").withColumn("w", F.pow(F.lit(LENGTH_FACTOR), F.col("class")))
    capped = F.coalesce(F.sum("words").over(by_source.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("w")).over(by_source.orderBy(F.desc("class")))
    t = t.withColumn("rate", F.when(rest > 0, (F.col("target") - MAX_COPIES * capped) / rest))
    t = t.withColumn("from", F.min(F.when(F.col("rate") * F.col("w") <= MAX_COPIES, F.col("class"))).over(by_source))
    rate = F.max(F.when(F.col("class") == F.col("from"), F.col("rate"))).over(by_source)
    free = F.greatest(F.lit(0.0), F.least(F.lit(float(MAX_COPIES)), rate * F.col("w")))
    expected = F.when(F.col("from").isNull() | (F.col("class") < F.col("from")), float(MAX_COPIES)).otherwise(free)
    return t.select("key", "class", "source_size", "target", expected.alias("expected"))


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document.

    size is the number of words of the text (null: 0), target the words that the mix takes of its source,
    copies how often the document is taken (0, 1 or 2), taken = copies * size.  A document without words
    is not taken.  A null source is one of its own.  Equal doc_ids of a source have equal random numbers
    and are ordered by size and text hash; equal rows may be told apart by chance only, with the same
    set of rows as the result.  No documents give no rows.  Other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    base = docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    base = base.withColumns({"class": F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(0), "row": F.monotonically_increasing_id()})
    base = materialize(base, "sizes")  # and with it the numbers of rows
    classes = materialize(base.groupBy("key", "class").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "classes")
    targets = source_targets(classes.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")))
    plan = materialize(_expected(classes.drop("source"), targets), "plan")  # 64 rows for each source at most

    certain = F.floor(F.col("expected")).cast("int")
    u = uniform(F.col("doc_id"), seed)
    p = F.col("expected") - certain
    rank = (u / (1 - u)) / (p / (1 - p))
    ranked = base.join(plan, ["key", "class"]).withColumns({"certain": certain, "rank": F.when((p > 1e-12) & (F.col("size") > 0), rank / (1 + rank))})
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int")).drop("class", "expected")
    ranked = materialize(ranked, "ranked")

    needs = ranked.groupBy("key").agg(F.first("target").alias("target"), F.sum(F.col("certain") * F.col("size")).alias("done"))
    needs = materialize(needs.select("key", (F.col("target") - F.col("done")).alias("need")), "needs")
    sums = ranked.where("bucket IS NOT NULL").groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words"))
    edge = sums.join(needs, "key").where("before <= need AND need < before + words").select("key", F.col("bucket").alias("edge"), "before")
    # a source that ends before its need is taken whole
    edge = needs.join(edge, "key", "left").select("key", "need", F.coalesce("edge", F.when(F.col("need") < 0, -1).otherwise(BUCKETS + 1)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before"))
    edge = materialize(edge, "edges")

    placed = ranked.join(edge, "key")
    order = Window.partitionBy("key").orderBy("rank", "doc_id", "size", "tie", "row")
    at_edge = placed.where("bucket = edge").withColumn("sum", F.col("before") + F.sum("size").over(order))
    chosen = materialize(at_edge.where("sum <= need").select("key", "row", "sum"), "chosen")  # while the target isn't passed
    top = chosen.groupBy("key").agg(F.max("sum").alias("sum"))
    gap = edge.where(f"edge <= {BUCKETS}").join(top, "key", "left").select("key", "edge", (F.col("need") - F.coalesce("sum", "before")).alias("gap"))
    gap = materialize(gap, "gaps")
    # then the one other document that comes nearest to what is left, if that is nearer than none
    free = ranked.join(gap, "key").where("bucket >= edge").join(chosen.select("row"), "row", "left_anti")
    best = free.groupBy("key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "rank", "doc_id", "tie", "row", "gap")).alias("best"))
    last = best.where("best.miss < best.gap").select(F.col("best.row").alias("row"))
    picked = chosen.select("row").unionByName(last).withColumn("picked", F.lit(1))

    out = placed.join(picked, "row", "left")
    extra = F.when(F.col("bucket") < F.col("edge"), 1).otherwise(F.coalesce("picked", F.lit(0)))
    copies = (F.col("certain") + F.when(F.col("bucket").isNotNull(), extra).otherwise(0)).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
