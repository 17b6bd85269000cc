"""Quality rules (operator 8): fixed text rules, then a calibrated hashed n-gram classifier.

The classifier is a logistic regression on hashed word 1- and 2-grams and character 1- to 3-grams (code
points), each family weighted by the share it has of the text.  It is fitted on labelled rows, whole
texts: at most ``MAX_FIT_ROWS`` of them with ``MAX_FIT_CHARS`` characters together, those with the least
hash of doc_id and text.  A fifth of these is held back to calibrate its probabilities (Platt scaling).  Its weights are one array of fixed size, and
scoring is one look-up per n-gram in Arrow batches, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .textnp import Words, span_hashes, words_of

MAX_FIT_ROWS, MAX_FIT_CHARS = 2500, 16 << 20
#: A longer labelled text isn't fitted on; it is judged like any other.
MAX_FIT_TEXT = 1 << 20
BUCKETS = 1 << 15
FAMILIES = ("word1", "word2", "char1", "char2", "char3")
SCALE = 8.0
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_PROBABILITY = 50, 50, 0.5
SYMBOLS = "#*$%&|<>"


def _families(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bounds of each text, bucket of each n-gram) of each family of a slice."""
    out, shift = [], np.uint64(64 - BUCKETS.bit_length() + 1)
    out.append((w.bounds, (w.hashes >> shift).astype(np.int64)))
    at, h = w.windows(2)
    out.append((np.searchsorted(at, w.bounds), (h >> shift).astype(np.int64)))
    b = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    text_at = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])[w.text_at]  # in code points
    for n in (1, 2, 3):
        code = b[: max(0, len(b) - n + 1)].copy()
        for k in range(1, n):
            code = code * np.uint64(0x110011) + b[k : len(b) - n + 1 + k]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> shift
        starts = np.minimum(text_at[:-1], len(code))
        counts = np.maximum(text_at[1:] - n + 1 - text_at[:-1], 0)  # n-grams that run into the next text don't count
        inside = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        out.append((np.concatenate([[0], np.cumsum(counts)]), code[inside].astype(np.int64)))
    return out


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass
class QualityModel:
    """Weights of all n-gram families in a row, bias, and Platt's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probabilities(self, w: Words) -> np.ndarray:
        """Calibrated probability that each text of a slice is good."""
        score = np.full(w.hi - w.lo, self.bias)
        for k, (bounds, code) in enumerate(_families(w)):
            n = np.diff(bounds)
            score += _row_sums(self.weights[k * BUCKETS + code], bounds) * (SCALE / np.maximum(n, 1))
        return _sigmoid(self.slope * score + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(index, value, row, y, size, rounds=60, l2=1e-4, memory=8):
    """Weights and bias of an L2-regularised logistic regression on sparse rows, by L-BFGS.  row is sorted."""
    used, place = np.unique(index, return_inverse=True)
    n, k = len(y), len(used)
    first = np.searchsorted(row, np.arange(n))
    some = np.diff(np.append(first, len(row))) > 0

    def at(p):
        """(loss, gradient): weights first, the bias last."""
        z = np.full(n, p[k])
        if some.any():
            z[some] += np.add.reduceat(value * p[place], first[some])
        g = (_sigmoid(z) - y) / n
        loss = np.mean(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (p[:k] @ p[:k])
        return loss, np.append(np.bincount(place, value * g[row], k) + l2 * p[:k], g.sum())

    p = np.zeros(k + 1)
    loss, g = at(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, a = -g, []
        for s, v in reversed(past):
            a.append((s @ d) / (s @ v))
            d = d - a[-1] * v
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, v), b in zip(past, reversed(a)):
            d = d + (b - (v @ d) / (s @ v)) * s
        step, slope = 1.0, g @ d
        while step > 1e-6:
            new, new_g = at(p + step * d)
            if new <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, v = step * d, new_g - g
        if s @ v > 1e-12:
            past = [*past, (s, v)][-memory:]
        done = loss - new < 1e-7
        p, loss, g = p + s, new, new_g
        if done:
            break
    out = np.zeros(size)
    out[used] = p[:k]
    return out, float(p[k])


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit probabilities to held-back labels, with Platt's smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([z, np.ones_like(z)])
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ c)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * c)
        c = c - step
        if abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, chars: int = MAX_FIT_CHARS) -> DataFrame:
    """(doc_id, text, y): at most ``bound`` labelled rows of ``chars`` characters together, whole texts,
    those with the least hash of doc_id and text; equal rows count once, and rows of more than
    MAX_FIT_TEXT characters not at all.  A doc_id with several labels has their majority, 1 on a tie; null
    labels don't count.  Only the ids and labels are broadcast, twice ``bound`` rows at most."""
    y = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * bound)
    rows = docs.select("doc_id", "text").where(f"length(text) <= {MAX_FIT_TEXT}").join(F.broadcast(y), "doc_id").withColumn("spot", F.xxhash64("doc_id", "text"))
    sizes = rows.groupBy("spot").agg(F.max(F.length("text")).alias("size")).orderBy("spot").limit(bound).collect()
    total = np.cumsum([r["size"] for r in sizes])
    kept = [r.spot for r, t in zip(sizes, total) if t <= chars]
    rows = rows.where(F.col("spot") <= F.lit(kept[-1] if kept else -(1 << 63)).cast("long"))
    return rows.dropDuplicates(["spot"]).select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_FIT_ROWS, chars: int = MAX_FIT_CHARS) -> QualityModel | None:
    """The classifier, or None where labels don't have both values."""

    def emit(batches):
        for batch in batches:
            y = batch.column("y").to_numpy()
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for w in words_of(batch.column("text")):
                fam = _families(w)
                for d in range(w.hi - w.lo):
                    index, value = [], []
                    for k, (bounds, code) in enumerate(fam):
                        part, n = np.unique(code[bounds[d] : bounds[d + 1]], return_counts=True)
                        index.append(part + k * BUCKETS)
                        value.append(n * (SCALE / max(1, n.sum())))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(y[w.lo + d : w.lo + d + 1], pa.int32()), pa.array(held[w.lo + d : w.lo + d + 1]),
                            pa.array([np.concatenate(index).astype(np.int32).tobytes()]), pa.array([np.concatenate(value).astype(np.float32).tobytes()]),
                        ],
                        ["y", "held", "i", "v"],
                    )

    rows = labelled_sample(docs, labels, label="quality", bound=bound, chars=chars).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0)
    got = in_batches(rows.select("text", F.col("y").cast("int"), "held"), emit, "y int, held boolean, i binary, v binary").collect()
    y, held = np.array([r.y for r in got]), np.array([r.held for r in got], bool)
    if len(got) < 2 or len(set(y[~held])) < 2:
        return None
    lengths = np.array([len(r.i) // 4 for r in got])
    index = np.frombuffer(b"".join(bytes(r.i) for r in got), np.int32)
    value = np.frombuffer(b"".join(bytes(r.v) for r in got), np.float32)
    del got
    row = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    place = (np.cumsum(~held) - 1).astype(np.int32)
    fit = ~held[row]
    weights, bias = _logistic(index[fit], value[fit], place[row[fit]], y[~held], BUCKETS * len(FAMILIES))
    z = np.bincount(row, value * weights[index], len(y)) + bias
    return QualityModel(weights, bias, *_platt(z[held], y[held]))


def _rules(w: Words) -> dict[str, np.ndarray]:
    """The fixed counts of every text of a slice."""
    n_texts = w.hi - w.lo
    n_words = w.counts()
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
    chars = _row_sums((lead[w.end] - lead[w.start]).astype(float), w.bounds).astype(np.int64)
    is_symbol = np.isin(w.data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    symbols = np.concatenate([[0], np.cumsum(is_symbol)])
    symbols = symbols[w.text_at[1:]] - symbols[w.text_at[:-1]]
    # lines: bounds at every \n and at the ends of texts
    breaks = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.text_at[:-1], breaks + 1]))
    starts = starts[starts < len(w.data)]
    line_text = np.searchsorted(w.text_at, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(w.data)), w.text_at[line_text + 1])
    last = ends - 1
    ends = np.where((ends > starts) & (w.data[np.maximum(last, 0)] == 10), last, ends)
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_text = starts[has_word], ends[has_word], line_text[has_word]
    h = span_hashes(w.data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), 0x94D049BB133111EB, starts, ends)
    dup = np.zeros(n_texts, np.int64)
    if len(h):
        order = np.lexsort((h, line_text))
        again = (h[order][1:] == h[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
        dup = np.bincount(line_text[order][1:][again], minlength=n_texts)
    # words under 3-word windows that stand twice or more in their text
    at, g = w.windows(3)
    repeat = np.zeros(n_texts, np.int64)
    if len(at):
        text = w.text_of()[at]
        order = np.lexsort((g, text))
        same = (g[order][1:] == g[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        under = np.zeros(len(w.hashes) + 3, bool)
        under[hit] = under[hit + 1] = under[hit + 2] = True
        repeat = np.bincount(w.text_of()[under[: len(w.hashes)]], minlength=n_texts)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The columns of docs' doc_id, the fixed counts, base_failed, p_good and kept.

    A null or empty text has no word, so it fails the fixed rules.  Without a model (no labels of
    both kinds) p_good is null and the fixed rules alone decide.  Each input row gives one row;
    other columns are ignored.
    """

    def emit(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words_of(batch.column("text")):
                c = _rules(w)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                p = model.probabilities(w) if model else None
                kept = ~failed if p is None else ~failed & (p >= MIN_PROBABILITY)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.lo, w.hi - w.lo), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(p, pa.float64()) if p is not None else pa.nulls(len(kept), pa.float64()), pa.array(kept)],
                    ["doc_id", *c, "base_failed", "p_good", "kept"],
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, schema)

