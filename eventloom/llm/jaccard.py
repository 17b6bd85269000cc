"""N-gram Jaccard join with grouped prefixes (operator 6).

1. Texts with the same shingle set are one class, kept by its smallest id.
2. A set's shingles are put in one global order: by how many documents hold them, the rarest first, then by
   hash.  Two sets of sizes x <= y with a Jaccard similarity of t or more share a shingle among the first
   y - ceil(t*y) + 1, and k shingles among the first y - ceil(t*y) + k.
3. Classes with the same prefix and the same size are one group (Bouros, Ge and Mamoulis, 2012).
4. Groups that share a prefix shingle are paired in two rounds.  The first pairs a group with one
   leader only, the one under each shared shingle that has the least of its own: linear in the
   index, and enough to connect nearly every group of copies with what they are copies of.  The second
   pairs what is left, that is groups under one shingle that are not yet in one component, and expands
   group pairs into members.  A shingle that more than ``BUCKET`` such groups hold is no key by itself:
   its groups are dealt by that and one more shared shingle, and then by a third (``EXTRA``), so that a
   shingle of very many unlike texts makes no pairs of all with all.  Where they would meet more often then,
   as near copies do that share most of their prefixes, they are paired under it, in parts.  Pairs under a
   key of more than ``FEW`` groups are held against the prefixes within the join.  A pair within a component can't
   change a component, so no link is lost.
5. Every pair is verified on the whole sets.  A set is sent once for each of its pairs with a leader, the
   leader's own set once for each ``FAN`` of them, and a task holds one leader's set at a time.

How common a shingle is has no influence on results, only on how many pairs are tried.  Sets are
sets of 64-bit hashes: two sets are compared as if no two different shingles in them collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import build, holds
from .common import BATCH_BYTES, in_batches, materialize
from .components import connected_components
from .textnp import span_hashes, words_of

#: A shingle that so many documents hold is common; a level more for each LEVEL_FACTOR times as many.
COMMON_FROM, LEVEL_FACTOR, LEVELS = 4, 4, 8
#: Shingles that a task sends to be counted together (16 MB).
BLOCK = 1 << 21
#: Counts go by so many first bits of a hash: those that make a range, and the rest.
RANGE_BITS, REST_BITS = 10, 26
#: Bits of the filter on common shingles and their levels (16 MB).  It holds one shingle for COMMON_SHARE bits at most;
#: where more are common, those of the lowest levels count as rare, and the order is coarser.
COMMON_BITS, COMMON_SHARE = 1 << 27, 16
#: Bits of the filter on ids whose sets verification needs (1 MB); more ids only make it weaker.
FILTER_BITS = 1 << 23
#: Bits of the filter on prefix shingles that are indexed (16 MB); more shingles only make it weaker.
INDEX_BITS = 1 << 27
#: Groups under one key that are paired with each other; more are dealt by further shingles, up to EXTRA.
BUCKET, EXTRA = 256, 2
#: Groups under one key whose pairs are held against their prefixes only after the pairs of all keys are put together.
FEW = 8
#: Pairs with one leader that are verified in a row.
FAN = 1000


def _sets(batch: pa.RecordBatch, k: int, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; a text of fewer words is one shingle."""
    for w in words_of(batch.column("text"), lower=True):
        at, h = w.windows(k)
        cut = np.searchsorted(at, w.bounds)
        counts = w.counts()
        for d in range(w.hi - w.lo):
            if wanted is not None and not wanted[w.lo + d]:
                continue
            if counts[d] >= k:
                found = np.unique(h[cut[d] : cut[d + 1]])
            elif counts[d]:
                lo, hi = w.bounds[d : d + 2]
                found = span_hashes(w.hashes[lo:hi], 0x2545F4914F6CDD1D, np.array([0]), np.array([hi - lo]))
            else:
                found = np.zeros(0, np.uint64)
            yield w.lo + d, found


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _short(s: np.ndarray) -> np.ndarray:
    """The bits of shingle hashes that counts go by."""
    return s >> np.uint64(64 - RANGE_BITS - REST_BITS)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """A bit set of common shingles, each by itself and with its level (``_levels``).

    Every shingle of every document is counted, by the first bits of its hash.  Tasks put the shingles of
    blocks of about ``BLOCK`` in order and send the steps from one to the next by range, which takes about
    two bytes for each; a range is counted by one task."""

    def packed(parts):
        t = _short(np.sort(np.concatenate(parts)))
        cut = np.searchsorted(t, np.arange((1 << RANGE_BITS) + 1, dtype=np.uint64) << np.uint64(REST_BITS))
        rest = (t & np.uint64((1 << REST_BITS) - 1)).astype(np.uint32)
        at = np.flatnonzero(np.diff(cut))
        data = []
        for r in at:
            steps = np.diff(rest[cut[r] : cut[r + 1]], prepend=np.uint32(0))
            data.append(pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.diff(cut)[at], pa.int64()), pa.array(data, pa.binary())], ["range", "n", "data"])

    def emit(batches):
        parts, size = [], 0
        for batch in batches:
            for _, s in _sets(batch, k):
                parts.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    def counted(key, table):
        parts = []
        for n, data in zip(table.column("n").to_pylist(), table.column("data").to_pylist()):
            steps = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, -1)
            parts.append(np.cumsum(np.ascontiguousarray(steps.T).view(np.uint32).ravel(), dtype=np.uint32))
        t, n = np.unique(np.concatenate(parts), return_counts=True)
        t, n = t[n >= COMMON_FROM], n[n >= COMMON_FROM]
        t = t.astype(np.int64) + (key[0].as_py() << REST_BITS)
        level = np.searchsorted(COMMON_FROM * LEVEL_FACTOR ** np.arange(1, LEVELS), n, side="right") + 1
        return pa.table([pa.array(t), pa.array(level.astype(np.int64))], ["t", "level"])

    blocks = in_batches(docs.select("text"), emit, "range long, n long, data binary")
    counts = materialize(blocks.groupBy("range").applyInArrow(counted, "t long, level long"), "common")
    # the most common ones that the bit set has room for
    held, least = 0, LEVELS + 1
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):
        held += row["count"]
        if held > COMMON_BITS // COMMON_SHARE:
            break
        least = row["level"]
    counts = counts.where(F.col("level") >= least)
    return build(counts.select(F.explode(F.array("t", F.col("t").bitwiseXOR(F.shiftleft("level", 56)))).alias("t")), COMMON_BITS)


def _levels(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """How common each shingle is: 0 for those that are not, then up with the number of documents."""
    out = np.zeros(len(s), np.int8)
    t = _short(s).view(np.int64)
    at = np.flatnonzero(holds(bits, t, COMMON_BITS))
    for level in range(1, LEVELS + 1):
        out[at[holds(bits, t[at] ^ np.int64(level << 56), COMMON_BITS)]] = level
    return out


def shingle_prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, pkey, prefix, own) of every text: set size, digest of the set, digest of size
    and prefix, the prefix and EXTRA shingles after it, and the percentage of shingles that are not
    common.  Sets too small to be like another set have no prefix."""
    common = common_shingles(docs, k)

    def emit(batches):
        for batch in batches:
            rows, n, sig, pkey, prefix, cut, own = [], [], [], [], [], [0], []
            for row, s in _sets(batch, k):
                first, level, key = np.zeros(0, np.uint64), np.zeros(0, np.int8), None
                if num * (len(s) + 1) <= den * len(s) and len(s):  # else only an equal set is like it
                    length = _prefix_length(len(s), num, den)
                    level = _levels(common, s)
                    first = s[np.argsort(level, kind="stable")[: length + EXTRA]]
                    key = hashlib.blake2b(first[:length].tobytes() + len(s).to_bytes(8, "big"), digest_size=16).digest()
                rows.append(row)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                pkey.append(key)
                own.append(100 - int(100 * (level > 0).mean()) if len(level) else 100)
                prefix.append(first.view(np.int64))
                cut.append(cut[-1] + len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("text_hash").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(pkey, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                    pa.array(own, pa.int32()),
                ],
                ["doc_id", "text_hash", "n", "sig", "pkey", "prefix", "own"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return in_batches(docs, emit, "doc_id long, text_hash long, n long, sig binary, pkey binary, prefix array<long>, own int")


def _index(heads: DataFrame) -> DataFrame:
    """(gid, n, own, at, t): prefix shingles that stand in two prefixes or more, and a few others: those
    that do are looked up in a bit set of fixed size, so that single ones aren't shuffled with their ids."""
    heads = heads.select("doc_id", "n", "own", F.slice("prefix", 1, F.col("length")).alias("prefix"))
    twice = heads.select(F.explode("prefix").alias("t")).groupBy("t").count().where("count > 1").select("t")
    bits = build(twice, INDEX_BITS)

    def emit(batches):
        for batch in batches:
            column = batch.column("prefix")
            size = column.value_lengths().to_numpy()
            t = column.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            keep = np.flatnonzero(holds(bits, t, INDEX_BITS))
            row = row[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("doc_id").to_numpy()[row]), pa.array(batch.column("n").to_numpy()[row]), pa.array(batch.column("own").to_numpy()[row]),
                    pa.array(at[keep].astype(np.int32)), pa.array(t[keep]),
                ],
                ["gid", "n", "own", "at", "t"],
            )

    return in_batches(heads, emit, "gid long, n int, own int, at int, t long")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of num / den or more; b leads."""
    pairs = materialize(pairs, "pairs")
    count = pairs.count()
    if not count:
        return pairs
    bits = build(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), FILTER_BITS)

    def emit(batches):
        for batch in batches:
            ids = _ids(batch)
            wanted = holds(bits, ids, FILTER_BITS)
            rows, out, size = [], [], 0
            for row, s in _sets(batch, k, wanted):
                rows.append(row)
                out.append(s.tobytes())
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "s"])
                    rows, out, size = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "s"])

    def check(batches):
        now, leaders = None, []  # the leader's sets: one, or several where its id stands for several texts
        for batch in batches:
            part, role, other = (batch.column(c).to_numpy() for c in ("b", "a", "part"))
            _, at, data = batch.column("s").buffers()
            at = np.frombuffer(at, np.int32)[batch.column("s").offset :][: batch.num_rows + 1]
            data = memoryview(data) if data is not None else b""
            keep = np.zeros(batch.num_rows, bool)
            for i, b, a, x in zip(range(batch.num_rows), part, role, other):
                if (b, x) != now:
                    now, leaders = (b, x), []
                p = np.frombuffer(data[at[i] : at[i + 1]], np.uint64)
                if a == b:
                    if not any(np.array_equal(p, q) for q in leaders):
                        leaders.append(p.copy())
                    continue
                for q in leaders:
                    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                    if den * both >= num * (len(p) + len(q) - both):
                        keep[i] = True
                        break
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    sets = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, "doc_id long, s binary")
    wide = materialize(pairs.groupBy("b").count().where(f"count > {FAN}").select("b", F.ceil(F.col("count") / FAN).alias("parts")), "wide", count)
    dealt = pairs.join(wide, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    roles = dealt.select(F.col("a").alias("doc_id"), "b", "part").unionByName(dealt.select(F.col("b").alias("doc_id"), "b", "part").distinct())
    rows = sets.join(roles, "doc_id").select("b", "part", F.col("doc_id").alias("a"), "s")
    rows = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a") != F.col("b"), "a")
    return in_batches(rows, check, "a long, b long").distinct()


def _alike(x: str, y: str, num: int, den: int) -> str:
    return f"{den} * least({x}, {y}) >= {num} * greatest({x}, {y})"


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text_hash, n_shingles, copy_of, component_id) of every row, for links of similarity num / den;
    text_hash is xxhash64(text), which tells the texts of a doc_id apart where it has several; copy_of is
    the least doc_id with an equal set.

    docs needs doc_id and text; other columns are ignored.  Words are runs of anything but ASCII
    white space, A-Z as a-z.  A null, empty or blank text has no shingle and no link; a text of fewer
    than k words is one shingle.  Rows that repeat a doc_id with the same text give the row again;
    with different texts, doc_id isn't a key and links hold for the id as a whole.  A null doc_id
    gets a row and a null component_id.
    """
    all_docs = docs.select("doc_id", "text")
    docs = all_docs.where("doc_id IS NOT NULL")
    base = materialize(shingle_prefixes(all_docs, k, num, den), "prefixes")
    rows = base.count()
    keyed = base.where("doc_id IS NOT NULL")
    rep_of = materialize(keyed.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep")), "reps", rows)
    # one row for each class, by its representative, and the group that it is in
    leaders = keyed.where("pkey IS NOT NULL").select("doc_id", "sig", "n", "pkey").join(rep_of.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig"]).distinct()
    group_of = leaders.groupBy("pkey").agg(F.min("doc_id").alias("gid"))
    members = materialize(leaders.join(group_of, "pkey").select("gid", "doc_id", "n"), "groups", rows)
    length = F.expr(f"CAST(n - (({num} * n + {den - 1}) DIV {den}) + 1 AS INT)")
    heads = keyed.where("pkey IS NOT NULL").select("doc_id", F.col("n").cast("int").alias("n"), "prefix", length.alias("length"), "own")
    index = materialize(_index(heads).join(members.where("gid = doc_id").select("gid").distinct(), "gid"), "group-index")
    shared = index.groupBy("t").agg(F.min(F.struct("own", "gid", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    shared = materialize(shared.select("t", "lead"), "shared")
    index = materialize(index.drop("own").join(shared, "t").select("t", "at", "gid", "n", F.col("lead.gid").alias("lead"), F.col("lead.n").alias("lead_n")), "index")

    # round 1: each group with the leader it shares most shingles with, each member with its group
    stars = index.where(f"gid != lead AND {_alike('n', 'lead_n', num, den)}").groupBy("gid", "lead").agg(F.count("*").alias("c"))
    stars = stars.groupBy("gid").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("b")).select(F.col("gid").alias("a"), "b")
    stars = stars.unionByName(members.where("gid != doc_id").select(F.col("doc_id").alias("a"), F.col("gid").alias("b")))
    links = materialize(verified(docs, stars, k, num, den), "links")
    comp = materialize(connected_components(links, rows=rows), "components", rows)

    # round 2: groups under one shingle whose members are not all in one component
    place = members.select("gid", "doc_id", "n").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    place = materialize(place, "places", rows)
    span = materialize(place.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")), "spans", rows)
    open_index = materialize(index.select(F.col("t").alias("key"), "at", "gid", "n").join(span, "gid"), "placed-index")
    pairs = materialize(_possible(_group_pairs(open_index, heads, num, den), heads, num, den), "group-pairs")
    inner = span.where("lo != hi").select("gid", F.col("gid").alias("gid2"))
    side = lambda c, s: place.select(F.col("gid").alias(f"gid{s}"), F.col("doc_id").alias(c), F.col("component").alias(f"component{s}"))
    rest = pairs.unionByName(inner).join(side("a", ""), "gid").join(side("b", "2"), "gid2").where("component != component2 AND (gid != gid2 OR a < b)").select("a", "b").distinct()
    more = materialize(verified(docs, rest, k, num, den), "links")
    if not more.isEmpty():
        comp = connected_components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    classes = rep_of.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component"), "rep")
    out = base.where("sig IS NOT NULL").select("doc_id", "text_hash", "n", "sig").join(classes, "sig", "left").drop("sig")
    # texts without a shingle are alone, and null keys would all meet in one task
    out = out.unionByName(base.where("sig IS NULL").select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("rep")))
    least = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), least("rep").alias("copy_of"), least("component").alias("component_id"))


def _of_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is one of ids, and a few others: ids are looked up in a bit set of fixed size, so that
    rows no join would keep aren't shuffled for it."""
    bits = build(ids, FILTER_BITS)

    def emit(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(bits, batch.column(column).to_numpy(), FILTER_BITS)))

    return in_batches(df, emit, df.schema)


def _group_pairs(rows: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """(gid, gid2): the pairs of groups under one key that may be alike and are not in one component, a table in
    the scratch folder.  rows: (key, at, gid, n, lo, hi), at being the place of the key's last shingle in the
    group's prefix.  Prefixes are read once, those of groups under keys of many; all later keys are theirs."""
    least = -(-num // max(den - num, 1))  # shingles of the smallest set that can be like another one
    extra = max(0, min(EXTRA, -(-num * least // den) - 1))  # of which so many besides the first are shared
    prefixes = heads.select(F.col("doc_id").alias("gid"), "prefix", "length")
    found = None

    def met(now, other, on, bound):
        other = other.select(*on, *(F.col(c).alias(f"{c}2") for c in other.columns if c not in on))
        # all that two sets share stands at or after their first shared shingle, which meets this bound
        most = f"({depth} + least(n - at, n2 - at2))"
        near = f"{_alike('n', 'n2', num, den)} AND {den} * {most} >= {num} * (n + n2 - {most})"
        apart = F.expr(f"gid < gid2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2) AND {near}")
        return now.join(other, on).where(apart & bound).select("gid", "gid2").distinct()

    for depth in range(extra + 1):
        keys = rows.groupBy("key").agg(F.min("lo").alias("l"), F.max("hi").alias("h"), F.count("*").alias("c")).where("l != h").select("key", "c")
        left = materialize(rows.join(materialize(keys, "open-keys"), "key"), "open")
        few = left.where(f"c <= {FEW}").drop("c")
        if found is None:
            found = materialize(_of_few(few, left.where(f"c > {FEW}"), num, den), "met")
            prefixes = materialize(_of_ids(prefixes, "gid", left.where(f"c > {FEW}").select("gid")), "open-prefixes")
        else:
            found = found.unionByName(materialize(met(few, few, ["key"], F.lit(True)), "met"))
        hot, dealt = left.where(f"c > {BUCKET}"), None
        if depth < extra and not hot.isEmpty():
            after = F.slice("prefix", F.col("at") + 2, F.greatest(F.col("length") + depth - F.col("at"), F.lit(0)))
            dealt = hot.join(prefixes, "gid").select("key", "c", "at", "gid", "n", "lo", "hi", F.posexplode(after).alias("pos", "t"))
            dealt = dealt.select(F.col("key").alias("was"), "c", F.xxhash64("key", "t").alias("key"), (F.col("at") + 1 + F.col("pos")).alias("at"), "gid", "n", "lo", "hi")
            # groups that share most of what comes next meet the more often for it, so they are paired here
            sizes = dealt.groupBy("was", "c", "key").agg(F.count("*").alias("d"), F.min("lo").alias("l"), F.max("hi").alias("h"))
            sizes = sizes.groupBy("was", "c").agg(F.coalesce(F.sum(F.expr("CASE WHEN l != h THEN d * CAST(d AS DOUBLE) END")), F.lit(0.0)).alias("then"))
            less = materialize(sizes.where("then < c * CAST(c AS DOUBLE)").select("was"), "dealt-keys")
            left = left.join(less.withColumnRenamed("was", "key"), "key", "left_anti")
        many = left.where(f"c > {FEW}").join(prefixes.drop("length"), "gid")
        parts = F.ceil(F.col("c") / (4 * BUCKET))
        now = many.withColumn("part", F.pmod(F.xxhash64("gid"), parts)).drop("c")
        other = many.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("c")
        found = found.unionByName(materialize(met(now, other, ["key", "part"], _bound(num, den)), "met"))
        if dealt is None:
            return materialize(found.distinct(), "met")
        rows = materialize(dealt.join(less, "was").select("key", "at", "gid", "n", "lo", "hi").distinct(), "dealt")


def _of_few(few: DataFrame, rest: DataFrame, num: int, den: int) -> DataFrame:
    """(gid, gid2): the pairs under keys of few groups that may be alike.  Shingles that two prefixes share are
    open keys of both, so there are as many as keys they meet under, and of those in rest no more than the
    one has that has fewer: prefixes themselves aren't sent for what this rules out."""
    other = few.select("key", *(F.col(c).alias(f"{c}2") for c in ("at", "gid", "n", "lo", "hi")))
    near = F.expr(f"{den} * least(n - at, n2 - at2) >= {num} * (n + n2 - least(n - at, n2 - at2))")
    met = few.join(other, "key").where(F.expr(f"gid < gid2 AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2) AND {_alike('n', 'n2', num, den)}"))
    met = met.groupBy("gid", "gid2", "n", "n2").agg(F.count("*").alias("both"), F.max(near).alias("near")).where("near")
    more = rest.groupBy("gid").agg(F.count("*").alias("more"))
    met = met.join(more, "gid", "left").join(more.select(F.col("gid").alias("gid2"), F.col("more").alias("more2")), "gid2", "left")
    both = "(both + least(coalesce(more, 0), coalesce(more2, 0)))"
    after = lambda n: f"(({num} * {n} + {den - 1}) DIV {den} - 1)"  # noqa: E731  what a set has after its prefix
    most = f"greatest(least(n, {both} + {after('n2')}), least({both} + {after('n')}, n2))"
    return met.where(f"{den} * {most} >= {num} * (n + n2 - {most})").select("gid", "gid2").distinct()


def _bound(num: int, den: int):
    """Whether two prefixes leave it possible that their sets are alike.  Say x's last prefix shingle comes first
    in the order.  Up to it, what x and y share is in both prefixes; after it, x has n - size(prefix)
    shingles and y has at most those outside the shared part.  Either set may be that x."""
    both = F.size(F.array_intersect("prefix", "prefix2"))
    most = both + F.greatest(
        F.least(F.col("n") - both, F.col("n2") - F.size("prefix2")), F.least(F.col("n") - F.size("prefix"), F.col("n2") - both)
    )
    return den * most >= num * (F.col("n") + F.col("n2") - most)


def _possible(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The group pairs that their prefixes don't rule out."""
    ids = pairs.select("gid").unionByName(pairs.select(F.col("gid2").alias("gid")))
    heads = materialize(_of_ids(heads.select(F.col("doc_id").alias("gid"), "n", "prefix"), "gid", ids), "pair-prefixes")
    two = pairs.join(heads, "gid").join(heads.select(F.col("gid").alias("gid2"), F.col("n").alias("n2"), F.col("prefix").alias("prefix2")), "gid2")
    return two.where(_bound(num, den)).select("gid", "gid2")
