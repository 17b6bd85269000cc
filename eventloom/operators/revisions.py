"""Append-only observation logs: acceptance, heads, inheritance, budgets, publication checks.

The acceptance rules are order-dependent per key, but each depends on the past only through running
maxima and the last accepted value, so they are folds over a key's history (``scans.scan``), which spread a
hot key over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .scans import scan


def page_heads(df: DataFrame, key: str, clock: str, content: str, tie: str, checkpoint=cut) -> DataFrame:
    """Verdict of each observation in arrival order (tie): stale if its clock is older than the greatest
    so far, held if it is equal and the content differs from the first seen at that clock, same if it is
    equal with equal content, else accepted."""
    first = df.groupBy(F.col(key).alias("_k"), F.col(clock).alias("_c")).agg(F.min_by(content, tie).alias("_first"))
    top = scan(df, key, [tie], {"_top": ("max_before", F.col(clock))}, checkpoint)
    rows = top.join(first, F.col(key).eqNullSafe(F.col("_k")) & F.col(clock).eqNullSafe(F.col("_c")))
    verdict = (
        F.when(F.col("_top").isNull() | (F.col(clock) > F.col("_top")), "accepted")
        .when(F.col(clock) < F.col("_top"), "stale")
        .when(F.col(content) == F.col("_first"), "same")
        .otherwise("held")
    )
    return rows.select(*df.columns, verdict.alias("verdict"))


def inherit(df: DataFrame, key: str, order: list[str], value: str, out: str, checkpoint=cut) -> DataFrame:
    """The last known value up to each row of its key."""
    return scan(df, key, order, {out: ("last", F.col(value))}, checkpoint)


def gaps(df: DataFrame, key: str, clock: str, tie: str, longest: str, checkpoint=cut) -> DataFrame:
    """Per key: first, last, number and longest gap in seconds, and the number of gaps above a limit."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    step = scan(df, key, [clock, tie], {"_before": ("lag", F.col(clock))}, checkpoint).withColumn("_gap", seconds(clock) - seconds("_before"))
    return step.groupBy(key).agg(
        F.min(clock).alias("first"), F.max(clock).alias("last"), F.count("*").alias("n"), F.max("_gap").alias("longest"),
        F.count_if(F.col("_gap") > F.expr(longest)).alias("breaks"),
    )


def sessions(df: DataFrame, key: str, clock: str, tie: str, seconds: float, checkpoint=cut) -> DataFrame:
    """Rows with the number of their session: a new one after a gap of more than so many seconds."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    step = scan(df, key, [clock, tie], {"_before": ("lag", F.col(clock))}, checkpoint)
    new = F.coalesce((at(clock) - at("_before") > seconds * 1e6).cast("int"), F.lit(0))
    numbered = scan(step.withColumn("_new", new), key, [clock, tie], {"_n": ("sum", F.col("_new"))}, checkpoint)
    return numbered.withColumn("session", F.col("_n") + 1).drop("_before", "_new", "_n")


def rolling_counts(df: DataFrame, key: str, at: str, row: str, width: int, checkpoint=cut) -> DataFrame:
    """(row, n): rows of the key within ``width`` up to each row's time, both ends included.

    A row counts what has come up to its time and what had come before the window; both are running counts at
    a mark in one order of rows and marks."""
    mark = lambda shift, kind, one: F.struct((F.col(at) + shift).alias("at"), F.lit(kind).alias("kind"), F.lit(one).alias("one"))
    marks = df.select(key, F.col(row).alias("_row"), F.explode(F.array(mark(-width, 0, 0), mark(0, 1, 1), mark(0, 2, 0))).alias("m")).select(key, "_row", "m.*")
    counted = scan(marks, key, ["at", "kind", "_row"], {"n": ("sum", F.col("one"))}, checkpoint).where("kind != 1")
    return counted.groupBy("_row").agg((F.max("n") - F.min("n")).alias("n")).select(F.col("_row").alias(row), "n")


def full_comparison(a: DataFrame, b: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """Keys of two snapshots with their state: added, removed, changed or same."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content)), 256)
    x = a.select(*key, digest.alias("_x"))
    y = b.select(*key, digest.alias("_y"))
    state = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_x") != F.col("_y"), "changed").otherwise("same")
    return x.join(y, key, "full_outer").select(*key, state.alias("state"))


def reason_codes(**tests: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items()))), ",")


def content_root(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a digest of a table's rows in any order, and their number.  Four parts of the rows' SHA-256
    are added up, which is a partial aggregation, and the sums are digested: no rows are gathered."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = df.select(row.alias("h")).agg(*(F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)), F.count("*").alias("rows"))
    return sums.select(F.sha2(F.concat_ws("|", *(F.col(f"s{i}").cast("string") for i in range(4)), F.col("rows").cast("string")), 256).alias("root"), "rows")


def chunk_tree(df: DataFrame, key: str, width: int, columns: list[str], checkpoint=cut) -> DataFrame:
    """(level, n, digest, rows) of the Merkle tree over chunks of ``width`` keys each.

    Level 0 has the content root of each chunk (key from n * width on); a digest above is that of the two below it, or of
    the one where the second is missing.  The last level has one row, the root of the table."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    part = lambda i: F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    sums = df.select(F.floor(F.col(key) / width).cast("long").alias("n"), row.alias("h")).groupBy("n").agg(*(F.sum(part(i)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)), F.count("*").alias("rows"))
    level = checkpoint(sums.select("n", F.sha2(F.concat_ws("|", *(F.col(f"s{i}").cast("string") for i in range(4)), F.col("rows").cast("string")), 256).alias("digest"), "rows"))
    out, depth = level.withColumn("level", F.lit(0)), 0
    while (level.agg(F.max("n")).first()[0] or 0) > 0:
        depth += 1
        pair = level.groupBy(F.expr("n div 2").alias("n")).agg(F.min_by("digest", "n").alias("a"), F.max_by("digest", "n").alias("b"), F.count("*").alias("k"), F.sum("rows").alias("rows"))
        level = checkpoint(pair.select("n", F.sha2(F.concat_ws("|", "a", F.when(F.col("k") == 2, F.col("b")).otherwise("")), 256).alias("digest"), "rows"))
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("level", "n", "digest", "rows")


def damaged_chunks(chunks: DataFrame, tree: DataFrame, key: str, width: int, columns: list[str], checkpoint=cut) -> DataFrame:
    """(n) of the chunks among the given rows whose digest isn't the tree's; no other chunk is read."""
    own = chunk_tree(chunks, key, width, columns, checkpoint).where("level = 0").select("n", F.col("digest").alias("found"))
    return own.join(tree.where("level = 0").select("n", "digest"), "n", "left").where("digest IS NULL OR digest != found").select("n")
