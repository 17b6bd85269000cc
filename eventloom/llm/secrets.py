"""Secret scans with multipart credential linking (operator 2, DataFrame functions only).

Three base patterns find secrets that stand for themselves.  Weak parts don't: identifiers of an
account, values that could be its secret, and endpoints.  They are reported only where parts that
complete each other stand within ``REACH`` characters of each other in the same scope, a document:

* a weak value with an identifier (weak, or a base access key),
* a weak identifier with a secret value (weak, or a base assignment or hex key),
* an endpoint with both an identifier and a secret value.

Matches become rows once, with the lengths of the match and of what stands before it; running sums over
a text's matches give positions.  A weak part that overlaps a base span, or a weak part of an earlier
kind, is dropped: a running maximum of ends over the starts in order tells, so all of this is sorting
by text and position, near-linear in the matches of a text, and texts themselves are never shuffled.

Linking is an interval join by bins of ``REACH`` characters.  Parts of a kind are pre-aggregated to the
first and last position in each bin, and a part meets the aggregates of its own bin and of the bins
beside it: whether a partner is in reach is exact, and no pair is ever made, however many parts a
document has.  Matches never cross a bin's row, so neither hot scopes nor long texts make groups.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

REACH = 200
#: kind: (pattern, group that must be long enough, least length).  Fixed values of the contract.
BASE = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs of 24 or more: the matches of [0-9a-f]+ that are kept
}
#: Weak parts, reported only together: (pattern, group, least length), and what else a match must hold.
WEAK = {
    "ident": (r"(?i:client_?id|access_?key_?id|account_?id|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@=-]{3,}", 0, 0),
    "value": (r"[A-Za-z0-9+/_=-]{16,}", 0, 0),
    "endpoint": (r"(?i:https?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|ftp)://[^\s\"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?", 0, 0),
}
HOLDS = {"value": ("[A-Z]", "[a-z]", "[0-9]")}
KINDS = [*BASE, *WEAK]
#: What the weak parts need: which kinds are identifiers and which secret values.
IDENTIFIERS, VALUES = ("access", "ident"), ("assign", "hex", "value")


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (rank, at, gap, size, keep) of the leftmost matches: the number of the match, the length of
    what stands between it and the one before, its own length, and whether it counts."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def one(x, i):
        keep = F.length(F.regexp_extract(x["hit"], pattern, group)) >= least if group else F.length(x["hit"]) >= least
        if kind in HOLDS:
            keep = reduce(and_, (x["hit"].rlike(p) for p in HOLDS[kind]))
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), keep.alias("keep"))

    # the text after the last match has no match
    found = F.filter(F.transform(both, one), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<rank: int, at: int, gap: int, size: int, keep: boolean>>"))


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, t, rank, start, end) of every match that counts, in code points; equal rows of docs count
    once.  docs: (doc_id, t, text)."""
    text = F.col("text")
    # weak parts matter only in texts that hold an identifier and a value, base or weak
    may = lambda kinds: reduce(lambda x, y: x | y, (text.rlike((BASE | WEAK)[k][0]) for k in kinds))
    weak = F.concat(*(_found(text, k, *v) for k, v in WEAK.items()))
    weak = F.when(may(IDENTIFIERS) & may(VALUES), weak).otherwise(F.array().cast("array<struct<rank: int, at: int, gap: int, size: int, keep: boolean>>"))
    rows = docs.select("doc_id", "t", F.explode(F.concat(*(_found(text, k, *v) for k, v in BASE.items()), weak)).alias("m")).select("doc_id", "t", "m.*")
    rows = rows.groupBy("doc_id", "t", "rank", "at").agg(*(F.first(c).alias(c) for c in ("gap", "size", "keep")))
    before = Window.partitionBy("doc_id", "t", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("int"))
    return rows.where("keep").select("doc_id", "t", "rank", (F.col("end") - F.col("size")).alias("start"), "end")


def _apart(parts: DataFrame, kind: str, *earlier: str) -> DataFrame:
    """parts without those of a kind that overlap one of the earlier kinds.  Spans in order of their starts,
    looked up at a part's end: the largest end of those that start before it is past its start."""
    rank, others = KINDS.index(kind), [KINDS.index(k) for k in earlier]
    mine = F.col("rank") == rank
    order = Window.partitionBy("doc_id", "t").orderBy(F.when(mine, F.col("end")).otherwise(F.col("start")), ~mine).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("rank").isin(others), F.col("end"))).over(order)
    return parts.withColumn("reach", reach).where(~mine | (F.coalesce("reach", F.lit(0)) <= F.col("start"))).drop("reach")


def _line(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts that the rules of the method report.  parts: (doc_id, t, rank, start, end)."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("b")
    key, rank_of = ["doc_id", "t"], lambda kinds: [KINDS.index(k) for k in kinds]
    parts = parts.withColumns({"ident": F.col("rank").isin(rank_of(IDENTIFIERS)), "val": F.col("rank").isin(rank_of(VALUES))})
    ends = parts.where("ident OR val").select(*key, "ident", "start", "end", bins)
    # the extent of each role in each bin, sent to the bins beside it as well
    extent = ends.groupBy(*key, "b").agg(*(f(F.when(F.col("ident") == r, F.col(c))).alias(f"{n}_{c}") for n, r in (("i", True), ("v", False)) for f, c in ((F.min, "start"), (F.max, "end"))))
    near = extent.select(*key, F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("b").alias("of"), "i_start", "i_end", "v_start", "v_end")
    weak = parts.where(F.col("rank").isin(rank_of(WEAK))).select(*key, "rank", "start", "end", bins)

    def in_reach(role: str) -> Column:
        before = (F.col("of") < F.col("b")) & (F.col(f"{role}_end") >= F.col("start") - reach)
        after = (F.col("of") > F.col("b")) & (F.col(f"{role}_start") <= F.col("end") + reach)
        return F.coalesce(F.bool_or(F.col(f"{role}_start").isNotNull() & ((F.col("of") == F.col("b")) | before | after)), F.lit(False))

    met = weak.join(near, [*key, "b"]).groupBy(*key, "rank", "start", "end").agg(in_reach("i").alias("i"), in_reach("v").alias("v"))
    value, ident, endpoint = (KINDS.index(k) for k in ("value", "ident", "endpoint"))
    return met.where(f"(rank = {value} AND i) OR (rank = {ident} AND v) OR (rank = {endpoint} AND i AND v)").select(*key, "rank", "start", "end")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, rank, end, kind) by start and kind, code points with
    exclusive end; base are the base patterns' alone, spans also the weak parts that were linked.

    A null text is empty.  A weak part that overlaps a base span, or a weak one of an earlier kind, isn't
    one.  Parts are linked within equal doc_id and text, so repeated rows give equal rows, and a doc_id with
    two texts gives a row for each.  A null doc_id is kept as such, and its texts are scanned.  A text may
    have any number of matches.  Columns other than doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t"))
    # a null id is an id of its own while rows are grouped and joined
    keyed = docs.select(F.struct("doc_id").alias("doc_id"), "t", "text")
    parts = materialize(_parts(keyed), "parts")
    base = parts.where(F.col("rank") < len(BASE))
    # what overlaps a span of an earlier kind is part of that one
    apart = _apart(_apart(_apart(parts, "ident", *BASE), "endpoint", *BASE, "ident"), "value", *BASE, "ident", "endpoint")
    apart = materialize(apart, "apart", parts.count())
    linked = _linked(apart, reach).withColumn("more", F.lit(True))
    kinds = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    span = F.struct("start", "rank", "end", kinds.alias("kind"))
    found = base.withColumn("more", F.lit(False)).unionByName(linked).groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.when(~F.col("more"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    found = materialize(found, "spans", parts.count())
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    out = keyed.select("doc_id", "t").join(found, ["doc_id", "t"], "left")
    return out.select("doc_id.doc_id", *(F.coalesce(c, none).alias(c) for c in ("base", "spans")))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the digest of base, and the line of all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(F.encode(_line(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))
