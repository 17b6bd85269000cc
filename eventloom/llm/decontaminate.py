"""Benchmark decontamination (operator 7): CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of terms: runs of letters, digits and characters beyond ASCII, A-Z as a-z.  An
item of m terms is in a document if some stretch of it is within ``floor(m * max_edits / 100)`` term
edits of the item.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a sequence: step j emits the
present term and moves on by one with a random bit of (j, term).  Sequences at a small edit distance
emit equal terms at most steps, so edit distance becomes Hamming distance.  Items are sorted into size
classes that double (``LEAST``), and a class has windows of three quarters of its least size: documents
are embedded from every stride-th term on, items from each of their terms, both up to the window's end.

Bit sampling hashes the terms emitted at a few random steps, and windows that agree there are
candidates.  Each repetition samples within a random depth of the walk, uniform by its logarithm from the
class's least depth to twice the window, which is what a walk takes to its end: after many edits walks
rarely stay aligned to the end of an item, so shallow samples find what is edited densely, and deep ones
tell long windows apart.  The number of repetitions is what reaches the target recall in each of four
measurements of a class: its shortest items and all of them, with the edit limit used up at random and
evenly spread places.  If ``MAX_REPEATS`` isn't enough, a warning says which recall was reached.
Candidates are taken in parts of about ``PART`` and verified by the exact edit distance to the best
stretch.  Items of three and four terms have no edits to spare and are matched exactly.

The benchmark is taken in blocks of about ``BLOCK_CHARS`` characters, whose index is of bounded size and
goes to every task; documents are only scanned, never shuffled or gathered.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .textnp import mix, words_of

BLOCK_CHARS = 600_000
#: Items of fewer terms than MIN_TERMS match nothing: one or two terms stand anywhere by chance.
MIN_TERMS, SHORT = 3, 5
#: (least terms of an item, stride in documents, sampled steps, least depth) of each size class; later
#: classes double the first two.
CLASSES = ((5, 1, 3, 5), (10, 2, 4, 9), (20, 3, 5, 13), (40, 5, 5, 16))
BANDS = 2
TARGET_RECALL, MAX_REPEATS, TRIALS = 0.99, 128, 240
#: Candidates that are held at once.
PART = 1 << 19
TABLE_BITS = 1 << 20
#: Bits of the filter on which terms an item has (512 KB); more terms only make it weaker.
MEMBER_BITS = 1 << 22
_PAD = np.uint64(0x6A09E667F3BCC909)


class _Walks:
    """Walks over a sequence of terms.  The bits that move them on are drawn once for all size classes."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self.drawn: dict[tuple[int, int], np.ndarray] = {}

    def bits(self, seed: int, block: int) -> np.ndarray:
        """32 steps' bits for every term, and for a place behind them, where a walk stays."""
        if (seed, block) not in self.drawn:
            bits = np.zeros(len(self.h) + 1, np.uint32)
            bits[:-1] = mix(self.h ^ np.uint64(seed * 1000003 + 32 * block)) >> np.uint64(16)
            self.drawn[seed, block] = bits
        return self.drawn[seed, block]

    def emitted(self, start: np.ndarray, end: np.ndarray, wanted: set[int], seed: int) -> dict[int, np.ndarray]:
        """Terms emitted at the wanted steps by the walks from ``start``; a pad from ``end`` on."""
        out, at, move = {}, start.astype(np.uint32), np.empty(len(start), np.uint32)
        for j in range(max(wanted) + 1):
            if j % 32 == 0:
                bits = self.bits(seed, j // 32)
            if j in wanted:
                out[j] = np.where(at < end, np.take(self.h, at, mode="clip"), _PAD)
            np.take(bits, at, out=move, mode="clip")
            np.right_shift(move, np.uint32(j % 32), out=move)
            np.bitwise_and(move, np.uint32(1), out=move)
            np.add(at, move, out=at)
        return out


def _class(c: int) -> tuple[int, int, int, int]:
    """(window in terms, stride, sampled steps, least depth) of a size class."""
    least, stride, samples, depth = CLASSES[min(c, len(CLASSES) - 1)]
    more = max(0, c - len(CLASSES) + 1)
    least, stride = least << more, stride << more
    return least, stride, samples, depth


def _class_of(m: int) -> int:
    last = len(CLASSES) - 1
    known = max(i for i, c in enumerate(CLASSES) if c[0] <= m)
    return known if known < last else last + (m // CLASSES[last][0]).bit_length() - 1


@lru_cache(4096)
def _bands(c: int, repeat: int) -> tuple[int, list[list[int]]]:
    """Depth of a repetition, and the steps that each band samples: one in each part of the depth."""
    rng = np.random.Generator(np.random.PCG64([20240613, c, repeat]))
    window, _, samples, low = _class(c)
    depth = int(low * (2 * window / low) ** rng.random())
    cuts = np.linspace(0, depth, samples + 1).astype(int)
    return depth, [[int(rng.integers(a, b)) for a, b in zip(cuts[:-1], cuts[1:])] for _ in range(BANDS)]


def _keys(walks: _Walks, start: np.ndarray, end: np.ndarray, c: int, repeat: int) -> list[np.ndarray]:
    """Key of each window in each band of one repetition."""
    _, bands = _bands(c, repeat)
    end = np.minimum(end, start + _class(c)[0])
    emitted = walks.emitted(start, end, {j for b in bands for j in b}, repeat + 1)
    out = []
    for k, band in enumerate(bands):
        key = np.full(len(start), (repeat * BANDS + k) * 32 + c, np.uint64)
        for j in band:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + emitted[j])
        out.append(key)
    return out


def _room(offset: np.ndarray, size, c: int, repeat: int) -> np.ndarray:
    """Which terms of an item leave enough of it for a walk, which moves on at half its steps."""
    return (size - offset >= min(_bands(c, repeat)[0], _class(c)[0]) // 2) | (offset == 0)


def _edited(rng: np.random.Generator, t: np.ndarray, edits: int, even: bool) -> np.ndarray:
    """A term sequence with random insertions, deletions and substitutions at random or even places."""
    out = list(t)
    places = np.linspace(0, len(t) - 1, edits + 2)[1:-1].astype(int) if even else rng.permutation(len(t))[:edits]
    for at in sorted(set(places.tolist()), reverse=True):
        kind, new = int(rng.integers(3)), rng.integers(1 << 62, dtype=np.uint64)
        if kind == 0 or len(out) == 1:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        else:
            del out[at]
    return np.array(out, np.uint64)


@dataclass
class ItemIndex:
    """Items of one block, and for each class and repetition the sorted keys of their windows."""

    ids: np.ndarray
    terms: list[np.ndarray]
    max_edits: int
    members: np.ndarray = field(default_factory=lambda: np.zeros(MEMBER_BITS // 8, np.uint8))
    repeats: dict[int, int] = field(default_factory=dict)
    short: dict[int, list[tuple[np.ndarray, int]]] = field(default_factory=dict)
    keys: dict[tuple[int, int, int], tuple] = field(default_factory=dict)

    def limit(self, item: int) -> int:
        return len(self.terms[item]) * self.max_edits // 100

    def build(self, recall: float) -> ItemIndex:
        by_class: dict[int, list[int]] = {}
        for q, t in enumerate(self.terms):
            spot = (mix(t ^ mix(np.full(len(t), q, np.uint64))) & np.uint64(MEMBER_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(self.members, spot >> 3, np.uint8(1) << (spot & 7).astype(np.uint8))
            if len(t) >= SHORT:
                by_class.setdefault(_class_of(len(t)), []).append(q)
            elif len(t) >= MIN_TERMS:
                self.short.setdefault(len(t), []).append((t, q))
        for c, items in by_class.items():
            self.repeats[c] = self._repeats(c, items, recall)
            h = np.concatenate([self.terms[q] for q in items])
            size = np.array([len(self.terms[q]) for q in items])
            first = np.cumsum(size) - size
            item = np.repeat(np.array(items, np.int32), size)
            offset = (np.arange(len(h)) - np.repeat(first, size)).astype(np.int32)
            end = np.repeat(first + size, size)
            walks = _Walks(h)
            for r in range(self.repeats[c]):
                at = np.flatnonzero(_room(offset, end - np.arange(len(h)) + offset, c, r))
                for k, key in enumerate(_keys(walks, at, end[at], c, r)):
                    order = np.argsort(key, kind="stable")
                    bits = np.zeros(TABLE_BITS // 8, np.uint8)
                    np.bitwise_or.at(bits, (key & np.uint64(TABLE_BITS - 1)).astype(np.int64) >> 3, np.uint8(1) << (key & np.uint64(7)).astype(np.uint8))
                    self.keys[c, r, k] = (key[order], item[at][order], offset[at][order], bits)
        return self

    def _repeats(self, c: int, items: list[int], recall: float) -> int:
        """Repetitions that find the wanted share of passages with all edits of the limit, in each of four
        measurements: shortest or any items, edits at random or even places; at any place against the stride."""
        rng = np.random.Generator(np.random.PCG64([20240614, c]))
        least = min(len(self.terms[q]) for q in items)
        shortest = [q for q in items if len(self.terms[q]) == least]
        stride, parts, starts, owns, text_of, item_of = _class(c)[1], [], [], [], [], []
        at = 0
        for trial in range(4 * TRIALS):
            pick = shortest if trial % 2 else items
            t = self.terms[pick[int(rng.integers(len(pick)))]]
            e = _edited(rng, t, len(t) * self.max_edits // 100, bool(trial & 2))
            e = np.concatenate([e, rng.integers(1 << 62, size=2 * _class(c)[0], dtype=np.uint64)])
            mine, own = np.arange(int(rng.integers(stride)), len(e), stride), np.arange(len(t))
            starts.append(np.column_stack([mine + at, np.full(len(mine), at + len(e)), np.full(len(mine), trial)]))
            owns.append(np.column_stack([own + at + len(e), np.full(len(own), at + len(e) + len(t)), np.full(len(own), trial), own]))
            parts += [e, t]
            at += len(e) + len(t)
        h, a, b = np.concatenate(parts), np.concatenate(starts), np.concatenate(owns)
        found, walks = np.zeros(4 * TRIALS, bool), _Walks(h)
        for r in range(MAX_REPEATS):
            some = b[_room(b[:, 3], b[:, 1] - b[:, 0] + b[:, 3], c, r)]
            for x, y in zip(_keys(walks, a[:, 0], a[:, 1], c, r), _keys(walks, some[:, 0], some[:, 1], c, r)):
                x, y = (mix(k ^ mix(t.astype(np.uint64))) for k, t in ((x, a[:, 2]), (y, some[:, 2])))
                found[a[np.isin(x, y), 2]] = True
            reached = found.reshape(-1, 4).mean(0).min()
            if reached >= recall:
                return r + 2  # one more, since the first to reach it was picked by a measurement
        warnings.warn(f"{MAX_REPEATS} repetitions find {reached:.3f} of edited items of {least} terms or more, not {recall}", RuntimeWarning, stacklevel=2)
        return MAX_REPEATS


def _candidates(index: ItemIndex, h: np.ndarray, bounds: np.ndarray):
    """Parts of distinct (text, item, place) whose windows share a key; place is where the item would start.

    What keys have in common is counted first and then written out by ranges of the text, about PART candidates
    at a time, however many items share an opening and however often it stands in a text."""
    if not len(h):
        return
    counts = np.diff(bounds)
    within = np.arange(len(h)) - np.repeat(bounds[:-1], counts)
    text, end = np.repeat(np.arange(len(counts)), counts), np.repeat(bounds[1:], counts)
    for m, items in index.short.items():
        whole = within <= np.repeat(counts, counts) - m
        for t, q in items:
            at = np.flatnonzero(whole & (h == t[0]))
            for k in range(1, m):
                at = at[h[at + k] == t[k]]
            if len(at):
                yield np.column_stack([text[at], np.full(len(at), q), within[at]])
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, tuple]] = []
    per_start, walks = np.zeros(len(h), np.int64), _Walks(h)
    for c, repeats in index.repeats.items():
        start = np.flatnonzero(within % _class(c)[1] == 0)
        ends = end[start]
        for r in range(repeats):
            for k, key in enumerate(_keys(walks, start, ends, c, r)):
                keys, _, _, bits = index.keys[c, r, k]
                hit = np.flatnonzero((bits[(key & np.uint64(TABLE_BITS - 1)).astype(np.int64) >> 3] >> (key & np.uint64(7)).astype(np.uint8)) & 1)
                lo, hi = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                some = hi > lo
                hits.append((start[hit][some], lo[some], (hi - lo)[some], (c, r, k)))
                per_start[hits[-1][0]] += hits[-1][2]
    total = np.cumsum(per_start)
    a = 0
    while a < len(h) and (total[-1] > (total[a - 1] if a else 0)):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PART, "right")))
        out = []
        for s, lo, n, at in hits:
            x, y = np.searchsorted(s, [a, b])
            s, lo, n = s[x:y], lo[x:y], n[x:y]
            pick = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            s = np.repeat(s, n)
            _, item, offset, _ = index.keys[at]
            out.append(np.column_stack([text[s], item[pick], s - offset[pick] - bounds[text[s]]]))
        yield np.unique(np.concatenate(out), axis=0)
        a = b


def _best_stretch(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the stretch of a text nearest to an item: exact, whole table by rows.

    The first term of the stretch is found by the same pass over both sequences reversed."""

    def ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = np.arange(len(a) + 1)
        row = np.zeros(len(a) + 1, np.int64)
        for i, x in enumerate(b):
            new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (a != x)]))
            row = np.minimum.accumulate(new - place) + place
        return row

    row = ends(text, item)
    end = int(row.argmin())
    back = ends(text[:end][::-1], item[::-1])
    return int(row[end]), end - int(np.flatnonzero(back == back.min())[0]), end


def _likely(index: ItemIndex, h: np.ndarray, bounds: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Candidates, one for each stretch that verification takes together, in whose stretch enough terms of
    the item stand: every term of the item that the stretch lacks costs an edit."""
    d, q, place = found.T
    size = np.array([len(t) for t in index.terms], np.int64)[q]
    limit = size * index.max_edits // 100
    _, first = np.unique(np.column_stack([q, d, place // (limit + 1)]), axis=0, return_index=True)
    found, size, limit = found[first], size[first], limit[first]
    d, q, place = found.T
    lo = np.clip(place - 2 * limit - 2, 0, None) + bounds[d]
    hi = np.minimum(bounds[d] + place + size + 2 * limit + 2, bounds[d + 1])
    length = np.maximum(hi - lo, 0)
    keep = np.zeros(len(found), bool)
    ends = np.cumsum(length)
    a = 0
    while a < len(found):  # in parts of about a million terms
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 20))))
        n = length[a:b]
        at = np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        spot = (mix(h[at] ^ mix(np.repeat(q[a:b], n).astype(np.uint64))) & np.uint64(MEMBER_BITS - 1)).astype(np.int64)
        have = np.concatenate([[0], np.cumsum((index.members[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1, dtype=np.int64)])
        cut = np.concatenate([[0], np.cumsum(n)])
        keep[a:b] = have[cut[1:]] - have[cut[:-1]] >= size[a:b] - limit[a:b]
        a = b
    return found[keep]


def _matches(index: ItemIndex, h: np.ndarray, bounds: np.ndarray):
    """(text, item, first term, end term, edits): the best verified stretch of each text and item."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, q, place in (row for found in _candidates(index, h, bounds) for row in _likely(index, h, bounds, found).tolist()):
        item, limit = index.terms[q], index.limit(q)
        have = best.get((d, q))
        if have and have[0] == 0:
            continue
        lo, n = int(bounds[d]), int(bounds[d + 1] - bounds[d])
        if 0 <= place and place + len(item) <= n and np.array_equal(h[lo + place : lo + place + len(item)], item):
            best[d, q] = (0, place, place + len(item))
            continue
        a, b = max(0, place - 2 * limit - 2), min(n, place + len(item) + 2 * limit + 2)
        # a term that the stretch lacks costs an edit, however often the item has it
        if b <= a or len(item) - np.isin(item, h[lo + a : lo + b]).sum() > limit:
            continue
        edits, first, end = _best_stretch(h[lo + a : lo + b], item)
        if edits <= limit and (not have or edits < have[0]):
            best[d, q] = (edits, a + first, a + end)
    return [(d, q, first, end, edits) for (d, q), (edits, first, end) in sorted(best.items())]


def item_terms(texts: list[str | None]) -> list[np.ndarray]:
    """Term hashes of each item."""
    out: list[np.ndarray] = []
    for w in words_of(pa.array(texts, pa.string()), lower=True, terms=True):
        out += [w.hashes[a:b].copy() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: int = 20, recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, item_id, first_term, end_term, edits): each benchmark item found in each document, by
    its best stretch of terms; max_edits is the limit in percent of the item's terms.

    Null and empty texts, and items of fewer than MIN_TERMS terms, match nothing.  Items with equal texts are
    all reported.  Repeated documents give equal rows.  A null item_id or doc_id is kept as such.  Other columns are ignored.
    """
    schema = "doc_id long, item_id long, first_term int, end_term int, edits int"
    out = None
    for shared in _blocks(benchmark, max_edits, recall):

        def emit(batches, shared=shared):
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for w in words_of(batch.column("text"), lower=True, terms=True):
                    found = _matches(index, w.hashes, w.bounds)
                    if found:
                        d, q, a, b, e = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[w.lo + x] for x in d], pa.int64()), pa.array([index.ids[x] for x in q], pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(e, pa.int32())],
                            ["doc_id", "item_id", "first_term", "end_term", "edits"],
                        )

        part = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: int = 20, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of docs, all columns, in which ``find_leaks`` finds no item.  Rows are judged as they are
    read, one pass for each block of items."""
    for shared in _blocks(benchmark, max_edits, recall):

        def emit(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for w in words_of(batch.column("text"), lower=True, terms=True):
                    keep[[w.lo + found[0] for found in _matches(shared.value, w.hashes, w.bounds)]] = False
                yield batch.filter(pa.array(keep))

        docs = in_batches(docs, emit, docs.schema)
    return docs


def _blocks(benchmark: DataFrame, max_edits: int, recall: float):
    """Broadcast indexes of blocks of about BLOCK_CHARS characters of items each."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text") + 8)).first()[0] or 0) // BLOCK_CHARS))
    spot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = items.where(spot == k).collect()
        index = ItemIndex(np.array([r.item_id for r in rows], object), item_terms([r.text for r in rows]), max_edits)
        yield benchmark.sparkSession.sparkContext.broadcast(index.build(recall))
