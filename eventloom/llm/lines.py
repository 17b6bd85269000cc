"""Line dedup by distinct-site spread (operator 4, DataFrame functions only).

A line that stands on many sites is boilerplate.  Lines are compared trimmed, in lower case and with
runs of white space as one, by a 64-bit hash; blank lines don't count.  For every line hash that has
as many documents as the threshold has sites, a HyperLogLog sketch of its sites is built per task and
merged by aggregation.  Where the estimate is more than ``MARGIN`` standard errors from the threshold it
decides; near-threshold lines get exact distinct counts.  Then every document loses the lines found,
but the first document (least doc_id) that holds a line keeps it, so nothing is lost altogether.

Counting lines and building sketches are partial aggregations; lines reach documents by an equi-join
with one row for each line on one side, so a line of a third of all documents can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SITES = 8
LG_K = 10
#: Standard errors of a sketch estimate around the threshold within which sites are counted exactly.
MARGIN = 4.0


def line_hashes(text: Column) -> Column:
    """Hash of every line of a text, null for blank ones."""

    def one(line):
        flat = F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
        return F.when(flat != "", F.xxhash64(flat))

    return F.transform(F.split(text, "\n"), one)


def boilerplate_lines(hashes: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first_doc, sites, exact) of the lines on min_sites sites or more.  hashes: (doc_id, site,
    lines).  sites is the estimate or, where exact, the count."""
    each = hashes.select("doc_id", "site", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
    often = each.where("site IS NOT NULL").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("line")
    often = materialize(often, "frequent-lines")
    spread = each.join(often, "line").groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("line", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    error = MARGIN * 1.04 / (1 << LG_K) ** 0.5
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = materialize(spread.where(F.col("sites") >= low), "line-spread")
    near = spread.where(F.col("sites") <= high)
    exact = each.join(near.select("line"), "line").where("site IS NOT NULL").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("n"))
    near = near.join(exact.where(F.col("n") >= min_sites), "line").select("line", "first_doc", F.col("n").alias("sites"), F.lit(True).alias("exact"))
    return spread.where(F.col("sites") > high).withColumn("exact", F.lit(False)).unionByName(near)


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text without its boilerplate lines, and n_lines, n_removed (lines of the input, lines
    taken out).

    A line is taken out of all documents but the one with the least doc_id that holds it, where every
    occurrence stays.  Rows without a site count no site but lose lines all the same.  A null text stays
    null with 0 lines; a text may become empty.  Repeated rows of the least doc_id all keep the line;
    rows with a null doc_id are never the first.  All columns of docs are kept; columns n_lines and
    n_removed are replaced.
    """
    lines = line_hashes(F.col("text"))
    hashes = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), lines.alias("lines"))
    hashes = materialize(hashes, "line-hashes")
    found = materialize(boilerplate_lines(hashes, min_sites), "boilerplate")
    each = hashes.select("doc_id", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line"))
    gone = each.join(found, "line").where("doc_id IS NULL OR first_doc IS NULL OR doc_id != first_doc").groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    gone = materialize(gone, "lines-to-remove").select(F.col("doc_id").alias("gone_id"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # whatever docs' columns are called
    # texts are joined by sorting at every size, so that what a small table needs foretells a large one
    both = rows.join(gone.hint("merge"), F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id")), "left")
    text = F.col("row.text")
    pairs = F.arrays_zip(F.split(text, "\n").alias("t"), line_hashes(text).alias("h"))
    kept = F.transform(F.filter(pairs, lambda x: ~F.coalesce(F.array_contains(F.col("gone"), x["h"]), F.lit(False))), lambda x: x["t"])
    some = F.col("gone").isNotNull() & text.isNotNull()
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    out = both.select("row", n_lines.alias("n_lines"), F.when(some, kept).alias("kept"))
    cut = F.col("kept").isNotNull()
    new_text = F.when(cut, F.array_join("kept", "\n")).otherwise(text)
    removed = F.when(cut, F.col("n_lines") - F.size("kept")).otherwise(0).cast("long")
    columns = [new_text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, "n_lines", removed.alias("n_removed"))
