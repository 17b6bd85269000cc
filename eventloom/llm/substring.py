"""Substring dedup by level-wise doubling (operator 10).

A window of ``window`` words that stands in several documents is found from short windows up.  The
first level takes windows of a quarter of that length.  Of these, it is enough to count the anchors:
the one with the least hash among all that start in any stretch of ``window - length + 1`` words.
Equal windows have the same anchor at the same place, so no repeat is missed, and about one window
in twenty is counted.  Windows that repeat at one length are extended to twice that length, and so
on until the full length, or until no candidates survive:

level 1: anchors whose words stand in two documents or more;
level 2: windows of twice that length over the repeated anchor of a full window;
level 3: full windows over a repeated window of level 2.

Each level is a partial aggregation by hash.  What repeats is looked up in a bit set of fixed size at
the next level (a false hit only lets a window survive that the next level drops), and beyond that
size by a join.  The last level is a partial aggregation and an equi-join by a 128-bit hash of the words,
so a passage that a third of all documents hold is pre-aggregated, and its join can be split; two
different windows are taken for equal only if all 128 bits are.  Texts with the same words are one
class first: its smallest id stands for it.  Where a doc_id has several texts, each is a text of its
own with its own cuts: they are told apart by a hash of the text beside the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import build, holds
from .common import in_batches, materialize
from .textnp import Words, mix, span_hashes, words_of

#: Bits of the look-up of the windows that repeat at one level (8 MB); it is used for an eighth as
#: many windows at most.
FILTER_BITS = 1 << 26
#: Texts that are copies, broadcast up to this number (under 4 MB); more are left out by a shuffled join.
MAX_BROADCAST_IDS = 200_000
_SALT = np.uint64(0x9FB21C651E98DF25)
_SECOND = 0xAF251AF3B0F025B5


def _own_anchors(w: Words, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor word, hash of the anchor) of every full window: the anchor is the first of
    the short windows with the least hash among those that start in the stretch."""
    at, h = w.windows(length)
    span = window - length + 1
    if len(at) < span:
        return at[:0], at[:0], h[:0]
    rank = mix(h ^ _SALT)
    views = np.lib.stride_tricks.sliding_window_view(rank, span)
    text = w.text_of()[at]
    full = np.flatnonzero(text[: len(views)] == text[span - 1 :])
    pick = np.concatenate([views[full[lo : lo + (1 << 15)]].argmin(1) for lo in range(0, len(full), 1 << 15)] or [full])
    pick = pick + full
    return at[full], at[pick], h[pick]


def _scan(docs: DataFrame, extra: list[str], make: Callable, second: bool = False) -> DataFrame:
    """(doc_id, t, p, h[, h2]); make(words, batch) gives first words and hashes of windows, and second
    hashes if they are asked for."""

    def emit(batches):
        for batch in batches:
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "t"))
            for w in words_of(batch.column("text")):
                at, *h = make(w, batch)
                if len(at):
                    row = np.searchsorted(w.bounds, at, "right") - 1
                    p = (at - w.bounds[row]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row + w.lo], pa.int64()), pa.array(texts[row + w.lo], pa.int64()), pa.array(p), *(pa.array(x.view(np.int64)) for x in h)],
                        ["doc_id", "t", "p", "h", "h2"][: 3 + len(h)],
                    )

    return in_batches(docs.select("doc_id", "t", "text", *extra), emit, "doc_id long, t long, p int, h long" + ", h2 long" * second)


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    """(key, first): hashes that stand in two documents or more, and the smallest of these."""
    rows = rows.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return rows.where("first != last").select(*key, "first")


class _Survivors:
    """The windows of one level that repeat, for the next level to look up: a bit set of fixed size
    while they are few, else lists of positions joined to the texts."""

    def __init__(self, rows: DataFrame, name: str):
        self.name, self.bits = name, None
        found = materialize(_repeated(rows, "h").select("h"), name)
        self.n = found.count()
        if self.n <= FILTER_BITS // 8:
            self.bits = build(found, FILTER_BITS)
        else:
            held = rows.join(found, "h").groupBy("doc_id", "t").agg(F.collect_set("p").alias(name))
            self.lists = materialize(held, f"{name}-lists")

    def onto(self, docs: DataFrame) -> DataFrame:
        return docs if self.bits is not None else docs.join(self.lists, ["doc_id", "t"])

    def columns(self) -> list[str]:
        return [] if self.bits is not None else [self.name]


def _look_up(bits, name, w, batch, at, h) -> np.ndarray:
    if bits is not None:
        return holds(bits, h.view(np.int64), FILTER_BITS)
    column = batch.column(name).slice(w.lo, w.hi - w.lo)
    mask = np.zeros(len(w.hashes), bool)
    mask[column.flatten().to_numpy() + np.repeat(w.bounds[:-1], column.value_lengths().to_numpy())] = True
    return mask[at]


def _hashes(w: Words, size: int, at: np.ndarray) -> np.ndarray:
    starts, h = w.windows(size)
    return h[np.searchsorted(starts, at)]


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, t, p, first): every window of ``window`` words that starts in several documents, by
    document, text and first word, with the smallest doc_id it starts in.  docs: (doc_id, t, text), t
    telling the texts of a doc_id apart."""
    length = -(-window // 4)
    half = 2 * length
    none = docs.select("doc_id", "t", F.lit(0).alias("p"), F.col("doc_id").alias("first")).where("false")

    def level1(w, _):
        _, anchor, h = _own_anchors(w, length, window)
        anchor, pick = np.unique(anchor, return_index=True)
        return anchor, h[pick]

    one = _Survivors(_scan(docs, [], level1), "anchors")
    if not one.n:
        return none
    bits1, name1 = one.bits, one.name

    def doubles(w, batch):
        """Full windows over a repeated anchor, and for each the window of twice the length that
        holds the anchor: from the anchor on, or as late as the full window lets it."""
        start, anchor, h = _own_anchors(w, length, window)
        keep = _look_up(bits1, name1, w, batch, anchor, h)
        start, anchor = start[keep], anchor[keep]
        return start, np.minimum(anchor, start + window - half)

    def level2(w, batch):
        at = np.unique(doubles(w, batch)[1])
        return at, _hashes(w, half, at)

    two = _Survivors(_scan(one.onto(docs), one.columns(), level2), "doubles")
    if not two.n:
        return none
    bits2, name2 = two.bits, two.name

    def level3(w, batch):
        start, at = doubles(w, batch)
        start = start[_look_up(bits2, name2, w, batch, at, _hashes(w, half, at))]
        return start, _hashes(w, window, start), span_hashes(w.hashes, _SECOND, start, start + window)

    rows = _scan(two.onto(one.onto(docs)), one.columns() + two.columns(), level3, second=True)
    # a table of its own: the join has two plain exchanges, and the rows of a hot window can be split
    return rows.join(materialize(_repeated(rows, "h", "h2"), "repeated"), ["h", "h2"]).select("doc_id", "t", "p", "first")


def _digest(docs: DataFrame) -> DataFrame:
    """(doc_id, t, n_words, words): a digest of the word sequence."""

    def emit(batches):
        for batch in batches:
            n, out = [], []
            for w in words_of(batch.column("text")):
                n.append(w.counts())
                out += [hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "t", "n_words", "words"])

    return in_batches(docs.select("doc_id", "t", "text"), emit, "doc_id long, t long, n_words long, words binary")


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words under a window whose word
    sequence also starts in a document with a smaller doc_id; kept words are joined by one space.

    Words are runs of anything but ASCII white space, unchanged.  Windows are judged on the input.
    A null text has no word.  Rows that repeat a doc_id, with the same text or another, are judged each by
    its own text, and none of them counts as a smaller document for another.  Rows with a null doc_id
    are kept whole and count for no other document.  doc_id must be a number, or a string of one.
    Columns other than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    digests = materialize(_digest(keyed).where(f"n_words >= {int(window)}").select("doc_id", "t", "words"), "digests")
    n = digests.count()
    first = digests.groupBy("words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last")
    first = materialize(first, "classes", n)
    copies = materialize(digests.join(first, "words").where("doc_id != first").select("doc_id", "t").distinct(), "copies", n)
    few = copies.count() <= MAX_BROADCAST_IDS
    once = keyed.join(F.broadcast(copies) if few else copies, ["doc_id", "t"], "left_anti")
    cuts = repeated_windows(once, window).where("first < doc_id").groupBy("doc_id", "t").agg(F.collect_set("p").alias("cuts"))
    cuts = materialize(cuts.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", "t", F.lit(None).cast("array<int>").alias("cuts"), F.lit(True).alias("whole"))), "cuts")
    # rows without an id or a text lose nothing, and null keys would all meet in one task
    both = keyed.join(cuts, ["doc_id", "t"], "left").select("doc_id", "text", "cuts", "whole")
    rest = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", "text", F.lit(None).cast("array<int>").alias("cuts"), F.lit(None).cast("boolean").alias("whole"))

    def emit(batches):
        for batch in batches:
            ids, cuts, copy = batch.column("doc_id"), batch.column("cuts"), batch.column("whole").to_pylist()
            for w in words_of(batch.column("text")):
                n, gone, kept = w.counts(), [], []
                for d in range(w.hi - w.lo):
                    lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                    stay = np.ones(hi - lo, bool)
                    if copy[w.lo + d]:
                        stay[:] = False
                    elif cuts[w.lo + d].is_valid:
                        at, depth = cuts[w.lo + d].values.to_numpy(), np.zeros(hi - lo + 1, np.int32)
                        depth[at] += 1
                        depth[at + window] -= 1
                        stay = np.cumsum(depth)[:-1] == 0
                    gone.append(int((~stay).sum()))
                    kept.append(_join(w, lo, hi, stay))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.lo, w.hi - w.lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return in_batches(both.unionByName(rest), emit, "doc_id long, n_words long, n_removed long, kept string")


def _join(w: Words, lo: int, hi: int, stay: np.ndarray) -> str:
    """Kept words of a text joined by one space, with one copy of its bytes and no loop over words."""
    if not stay.any():
        return ""
    start, end = w.start[lo:hi][stay], w.end[lo:hi][stay]
    size = end - start + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    to = np.cumsum(size) - size
    n = size - 1
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to, n) + within] = w.data[np.repeat(start, n) + within]
    return out[:-1].tobytes().decode()
