"""Toxicity grades by cumulative-link ordinal regression (operator 9).

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds.  x are
sparse text features, the logarithms of the counts of the terms that screening found.  Terms are
words, and beginnings of words of ``PREFIXES`` bytes, for languages that build words; screening keeps
those whose share of toxic labelled documents is above or below that of others by ``MIN_Z`` standard
errors or more, at most ``MAX_TERMS``, so terms can speak for a text as well as against it.  Labels are 0
or 1, so grades are made from them: 0 is not toxic; toxic rows are graded 1 to 3 by how much of what
the labels of *other* rows mark stands in their text: the sample is halved by a hash of doc_id, each half
is screened by itself, and a row is graded by thirds of the summed logarithms of the counts of the terms
that the other half's screening marks.  So no row's own label takes part in what it is graded by.  Screening counts are a Spark
aggregation over the labelled sample, at most ``MAX_FIT_ROWS`` rows, those with the least hash of
doc_id.  Scoring looks up terms in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialize
from .quality import _sigmoid, labelled_sample
from .textnp import LOWER, Words, span_hashes, words_of

MAX_FIT_ROWS = 8000
MAX_TERMS = 4096
PREFIXES = (4, 5, 6, 7, 8)
MIN_Z, MIN_DOCS = 5.0, 6
GRADES = 3
_SIEVE = np.uint64((1 << 18) - 1)
_BASE = 0xA0761D6478BD642F
_LETTER = np.random.Generator(np.random.PCG64(20240615)).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


@dataclass
class ToxicityModel:
    """Sorted term hashes, their weights, and the thresholds between grades."""

    terms: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def score(self, w: Words) -> np.ndarray:
        row, term, n = _counts(w, self.terms, _sieve(self.terms))
        return np.bincount(row, self.weights[term] * np.log1p(n), w.hi - w.lo)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return _sigmoid(score[:, None] - self.theta[None, :])


def _terms(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of the words of a slice, and of their beginnings of each length."""
    text = w.text_of()
    out = [(text, w.hashes)]
    size = w.end - w.start
    values = _LETTER[w.data]
    for n in PREFIXES:
        at = np.flatnonzero(size >= n)
        out.append((text[at], span_hashes(values, _BASE, w.start[at], w.start[at] + n)))
    return out


def _counts(w: Words, terms: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) for each term that stands in a text, by text."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = []
    for text, h in _terms(w):
        hit = np.flatnonzero(sieve[(h & _SIEVE).astype(np.int64)])
        at = np.minimum(np.searchsorted(terms, h[hit]), len(terms) - 1)
        same = terms[at] == h[hit]
        keys.append(text[hit][same] * len(terms) + at[same])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // len(terms), key % len(terms), n


def _sieve(terms: np.ndarray) -> np.ndarray:
    out = np.zeros(int(_SIEVE) + 1, bool)
    out[(terms & _SIEVE).astype(np.int64)] = True
    return out


def _screen(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the terms that set toxic rows apart in all of the sample, and of those that mark toxic rows
    in its halves 0 and 1.  sample: (text, y, half)."""

    def emit(batches):
        for batch in batches:
            y, half = batch.column("y").to_numpy(), batch.column("half").to_numpy()
            for w in words_of(batch.column("text"), lower=True, terms=True):
                text, h = (np.concatenate(x) for x in zip(*_terms(w)))
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                row = text[first] + w.lo
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(y[row], pa.int32()), pa.array(half[row], pa.int32())], ["h", "y", "half"])

    none = np.zeros(0, np.uint64)
    total = {(r.half, r.y): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    ofs = lambda half, y: F.sum((F.col("half").isin(half) & (F.col("y") == y)).cast("int"))
    parts = {"all": [0, 1], "h0": [0], "h1": [1]}
    seen = in_batches(sample.select("text", "y", "half"), emit, "h long, y int, half int").groupBy("h").agg(*(ofs(of, y).alias(f"{name}_{y}") for name, of in parts.items() for y in (0, 1)))
    seen = materialize(seen.where(f"all_0 >= {MIN_DOCS} OR all_1 >= {MIN_DOCS}"), "terms")
    out = []
    for name, of in parts.items():
        a, b = (sum(total.get((half, y), 0) for half in of) for y in (1, 0))
        if not a or not b:
            out.append(none)
            continue
        p = (F.col(f"{name}_0") + F.col(f"{name}_1")) / (a + b)
        z = (F.col(f"{name}_1") / a - F.col(f"{name}_0") / b) / F.sqrt(p * (1 - p) * (1 / a + 1 / b) + 1e-12)
        keep = (F.col(f"{name}_1") >= MIN_DOCS) & (F.col("z") >= MIN_Z)
        if name == "all":
            keep |= (F.col("all_0") >= MIN_DOCS) & (F.col("z") <= -MIN_Z)
        top = seen.withColumn("z", z).where(keep).orderBy(F.desc(F.abs("z")), "h").limit(MAX_TERMS).select("h")
        out.append(np.sort(np.array([r.h for r in top.collect()], np.int64).view(np.uint64)))
    return out[0], out[1], out[2]


def _fit(row, term, value, grade, n_terms, rounds=400, rate=0.05, l2=1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by Adam on the ordinal likelihood."""
    n, k = len(grade), int(grade.max())
    share = np.array([(grade >= j).mean() for j in range(1, k + 1)])
    start = -np.log(share / (1 - share))
    # theta_1, and logarithms of the steps up, so that thresholds stay ordered
    p = np.concatenate([np.zeros(n_terms), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        w, steps = p[:n_terms], np.exp(p[n_terms + 1 :])
        theta = p[n_terms] + np.concatenate([[0.0], np.cumsum(steps)])
        s = np.bincount(row, w[term] * value, n)
        up = np.column_stack([np.ones(n), _sigmoid(s[:, None] - theta), np.zeros(n)])  # P(grade >= j)
        like = np.maximum(up[rows, grade] - up[rows, grade + 1], 1e-9)
        slope = up * (1 - up)
        lo, hi = slope[rows, grade] / like, slope[rows, grade + 1] / like
        gs = -(lo - hi) / n
        gt = np.zeros(k + 2)
        np.add.at(gt, grade, lo / n)
        np.add.at(gt, grade + 1, -hi / n)
        gt = gt[1 : k + 1]
        tail = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([np.bincount(term, gs[row] * value, n_terms) + l2 * w, tail[:1], tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_terms], p[n_terms] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_terms + 1 :]))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_FIT_ROWS) -> ToxicityModel | None:
    """The model, or None where labels don't have both values or no term marks toxic rows."""
    sample = labelled_sample(docs, labels, "toxic", bound).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)).cast("int"))
    sample = materialize(sample.select("text", "y", "half"), "labelled")
    terms, *marks = _screen(sample)
    if not len(terms):
        return None

    def emit(batches):
        for batch in batches:
            y, half = batch.column("y").to_numpy(), batch.column("half").to_numpy()
            for w in words_of(batch.column("text"), lower=True, terms=True):
                size = w.hi - w.lo
                row, term, n = _counts(w, terms, _sieve(terms))
                cut = np.searchsorted(row, np.arange(size + 1))
                marked = np.zeros((2, size))
                for k in (0, 1):  # by the other half's marks
                    of, _, times = _counts(w, marks[1 - k], _sieve(marks[1 - k]))
                    marked[k] = np.bincount(of, np.log1p(times), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(y[w.lo : w.hi], pa.int32()), pa.array(marked[half[w.lo : w.hi], np.arange(size)]),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int64())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(n, pa.int64())),
                    ],
                    ["y", "marked", "term", "n"],
                )

    got = in_batches(sample, emit, "y int, marked double, term array<long>, n array<long>").collect()
    y, marked = np.array([r.y for r in got]), np.array([r.marked for r in got])
    cuts = np.quantile(marked[y == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, marked, "right"), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # grades without a row don't count
    row = np.repeat(np.arange(len(got)), [len(r.term) for r in got])
    term = np.array([t for r in got for t in r.term], np.int64)
    value = np.log1p(np.array([c for r in got for c in r.n], float))
    return ToxicityModel(terms, *_fit(row, term, value, grade, len(terms)))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) of every document: expected grade, the last grade
    with a probability of a half or more of being reached, P(grade >= 1), and whether that is a half
    or more.

    A null or empty text has no term.  Without a model all are null but toxic, which is false.
    Repeated rows give a row each; columns other than doc_id and text are ignored.
    """

    def emit(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words_of(batch.column("text"), lower=True, terms=True):
                n = w.hi - w.lo
                if model is None:
                    out = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool))]
                else:
                    up = model.at_least(model.score(w))
                    out = [pa.array(up.sum(1)), pa.array((up >= 0.5).sum(1), pa.int32()), pa.array(up[:, 0]), pa.array(up[:, 0] >= 0.5)]
                yield pa.RecordBatch.from_arrays([ids.slice(w.lo, n), *out], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    schema = "doc_id long, severity double, grade int, p_toxic double, toxic boolean"
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, schema)
