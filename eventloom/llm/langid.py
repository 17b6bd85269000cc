"""Language identification with spans (operator 5).

Each word has a score per language, the sum of log-likelihood ratios of its hashed byte n-grams
(lengths 1 to 4, with the marks of its ends) and of the word itself.  Script ranges narrow the
candidates first: a language that never shows a script in training is no candidate for words of it.
A Viterbi pass over the words with a switching penalty then labels spans, so mixed-language text is
cut where evidence outweighs the penalty and single odd words don't switch.

Most texts have one label.  That is decided exactly without the full pass: if the largest gains that
runs of words give two other languages (from running sums and running minima) don't add up to more
than the penalty, no path with a switch beats the best single language.  The other texts are passed
through Viterbi together, one word position at a time.

Training counts n-grams in Spark over at most about ``MAX_FIT_ROWS`` labelled rows of each language,
those with the least hash of doc_id, whole texts; the model is a table of fixed size per language.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches
from .textnp import Words, mix, words_of

MAX_FIT_ROWS = 2000
BUCKETS = 1 << 16
MAX_ORDER = 4
SWITCH_PENALTY = 12.0
#: A word's score is bounded, so that no single word outweighs the penalty by itself.
WORD_BOUND = 6.0
SMOOTH = 0.5
#: A language is a candidate for a script if so large a share of its words show it.
MIN_SCRIPT_SHARE = 1e-4
#: First code point of each script range, and its name; letters of a range without a name are of another
#: script.  What is a letter is told by its Unicode category.  Fixed values of Unicode.
SCRIPTS = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""),
    (0x00B5, "latin"), (0x00B6, ""), (0x00BA, "latin"), (0x00BB, ""), (0x00C0, "latin"), (0x00D7, ""), (0x00D8, "latin"),
    (0x00F7, ""), (0x00F8, "latin"), (0x02B9, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x2C00, "other"), (0x2E00, ""), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, ""),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFF21, "latin"), (0xFF3B, ""),
    (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x20000, "han"), (0x30000, ""),
]
NAMES = sorted({name for _, name in SCRIPTS})


def _letters() -> np.ndarray:
    """Script of every code point, "" where it isn't a letter (categories L*)."""
    every = np.arange(sys.maxunicode + 1)
    script = np.array([NAMES.index(name or "other") for _, name in SCRIPTS], np.int8)[np.searchsorted([at for at, _ in SCRIPTS], every, "right") - 1]
    return np.where(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in every), bool, len(every)), script, np.int8(NAMES.index("")))


_KIND = _letters()
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct word of a slice, which of these each word is)."""
    _, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
    return first, which


def _features(w: Words, pick: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For the picked words of a slice: (first n-gram of each word, bucket) for words and each length of
    n-gram, by word; the script of each (that of most letters), and its number of letters."""
    start, size = w.start[pick], (w.end - w.start)[pick]
    # the words' bytes, each between marks
    total = size + 2
    to = np.cumsum(total) - total
    data = np.zeros(int(total.sum()), np.uint64)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    raw = w.data[np.repeat(start, size) + within]
    data[np.repeat(to + 1, size) + within] = raw.astype(np.uint64) + np.uint64(1)
    left = np.repeat(to + total, total) - np.arange(len(data))
    out = [(np.arange(len(pick)), (w.hashes[pick] >> _SHIFT).astype(np.int64))]
    code = data.copy()
    for k in range(MAX_ORDER):
        if k:
            code = code[:-1] * np.uint64(263) + data[k:]
        # single marks say nothing; every n-gram of more than k bytes lies in its word
        ok = (data > 0) if k == 0 else left[: len(code)] > k
        n = size if k == 0 else np.maximum(total - k, 0)
        bucket = (mix(code[ok] + np.uint64(k << 56)) >> _SHIFT).astype(np.int64)
        out.append((np.cumsum(n) - n, bucket))
    script, letters = _scripts(raw, np.repeat(np.arange(len(pick)), size), len(pick))
    return out, script, letters


def _scripts(raw: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Script and number of letters of each word, from the words' bytes."""
    lead = (raw & 0xC0) != 0x80
    text = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind = _KIND[text].astype(np.int64)
    keep = kind != NAMES.index("")
    counts = np.bincount(word[lead][keep] * len(NAMES) + kind[keep], minlength=n * len(NAMES)).reshape(-1, len(NAMES))
    letters = counts.sum(1)
    return np.where(letters > 0, counts.argmax(1), NAMES.index("")), letters


@dataclass
class LanguageModel:
    """Languages in order, log-ratio by n-gram bucket and language, and which scripts each writes."""

    languages: list[str]
    ratios: np.ndarray
    scripts: np.ndarray

    def word_scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word and language, letters of each word).  Words without letters and words
        whose script no language writes score 0 for all."""
        pick, which = _distinct(w)
        out = np.zeros((len(pick), len(self.languages)))
        if not len(pick):
            return out, np.zeros(0, np.int64)
        features, script, letters = _features(w, pick)
        grams = np.zeros(len(pick))
        for first, bucket in features:
            size = np.diff(np.append(first, len(bucket)))
            some = size > 0
            out[some] += np.add.reduceat(self.ratios[bucket], first[some], axis=0)
            grams += size
        out *= (2.0 / np.sqrt(grams))[:, None]
        np.clip(out, -WORD_BOUND, WORD_BOUND, out=out)
        allowed = self.scripts[script]
        none = ~allowed.any(1) | (letters == 0)
        out[~allowed] = -WORD_BOUND
        out[none] = 0.0
        return out[which], letters[which]


def _rows(docs: DataFrame, label: str) -> DataFrame:
    """(text, lang): labelled rows, about MAX_FIT_ROWS of each language at most, picked by hash."""
    docs = docs.where(f"text IS NOT NULL AND {label} IS NOT NULL").select("doc_id", "text", F.col(label).alias("lang"))
    counts = docs.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(MAX_FIT_ROWS)) / F.col("count"))
    rates = {r.lang: r.s for r in counts.select("lang", share.alias("s")).collect()}  # one row for each language
    if not rates:
        return docs.where("false").select("text", "lang")
    pick = F.lit(0.0)
    for lang, s in rates.items():
        pick = F.when(F.col("lang") == lang, F.lit(s)).otherwise(pick)
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.where(spot < pick).select("text", "lang")


def fit_languages(docs: DataFrame, label: str = "lang") -> LanguageModel | None:
    """The model from rows with a text and a label; None if there are none."""

    def emit(batches):
        seen: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for w in words_of(batch.column("text"), lower=True):
                features, script, _ = _features(w, np.arange(len(w.hashes)))
                of = lang[w.lo + w.text_of()] if len(w.hashes) else np.zeros(0, object)
                for name in set(of.tolist()):
                    mine = of == name
                    both = seen.setdefault(name, [np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)])
                    for first, bucket in features:
                        own = np.repeat(mine, np.diff(np.append(first, len(bucket))))
                        both[0] += np.bincount(bucket[own], minlength=BUCKETS)
                    both[1] += np.bincount(script[mine], minlength=len(NAMES))
        for name, (grams, scripts) in seen.items():
            count = np.concatenate([grams, scripts])
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], ["lang", "f", "n"])

    got = in_batches(_rows(docs, label), emit, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n"))
    got = got.toPandas()  # BUCKETS + scripts rows for each language at most
    if not len(got):
        return None
    names = sorted(got["lang"].unique())
    table = np.zeros((len(names), BUCKETS + len(NAMES)))
    table[got["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(), got["f"].to_numpy()] = got["n"].to_numpy()
    grams, scripts = table[:, :BUCKETS] + SMOOTH, table[:, BUCKETS:]
    logs = np.log(grams / grams.sum(1, keepdims=True))
    ratios = np.ascontiguousarray((logs - logs.mean(0, keepdims=True)).T)
    total = scripts[:, [i for i, x in enumerate(NAMES) if x]].sum(1, keepdims=True)
    return LanguageModel(names, ratios, (scripts >= MIN_SCRIPT_SHARE * np.maximum(total, 1)).T)


def _constant(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(best single language of each text, whether that is the best path)."""
    n, k = len(bounds) - 1, scores.shape[1]
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(scores, 0)])
    best = (sums[bounds[1:]] - sums[bounds[:-1]]).argmax(1)
    gain = scores - np.take_along_axis(scores, np.repeat(best, np.diff(bounds))[:, None], 1) if len(scores) else scores
    # what all gains of a language add up to bounds what a run of it can gain
    total = np.concatenate([np.zeros((1, k)), np.cumsum(np.maximum(gain, 0), 0)])
    most = total[bounds[1:]] - total[bounds[:-1]]
    two = lambda m: np.sort(m, 1)[:, -2:].sum(1)
    for d in np.flatnonzero(two(most) > penalty):
        run = np.concatenate([np.zeros((1, k)), np.cumsum(gain[bounds[d] : bounds[d + 1]], 0)])
        most[d] = (run - np.minimum.accumulate(run, 0)).max(0)
    return best, two(most) <= penalty


def _viterbi(scores: np.ndarray, bounds: np.ndarray, texts: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best paths of some texts, all advanced together by word position, longest first."""
    size = np.diff(bounds)[texts]
    order = np.argsort(-size, kind="stable")
    texts, size = texts[order], size[order]
    first, n_lang = bounds[texts], scores.shape[1]
    kind = np.min_scalar_type(n_lang)
    value = scores[first].copy()
    back = np.zeros((int(size.sum()), n_lang), kind)
    at = np.cumsum(size) - size
    for t in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))  # texts with more than t words
        v = value[:live]
        top = v.argmax(1)
        jump = v[np.arange(live), top] - penalty
        stay = v >= jump[:, None]
        back[at[:live] + t] = np.where(stay, np.arange(n_lang), top[:, None])
        value[:live] = np.where(stay, v, jump[:, None]) + scores[first[:live] + t]
    path = np.zeros(len(back), kind)
    state = value.argmax(1)
    for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -t, "left"))
        path[at[:live] + t] = state[:live]
        state[:live] = back[at[:live] + t, state[:live]]
    out: list[np.ndarray] = [path[:0]] * len(order)
    for i, d in enumerate(order):
        out[d] = path[at[i] : at[i] + size[i]]
    return out


def label_words(model: LanguageModel, w: Words, penalty: float = SWITCH_PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(language of each word, letters of each word) of a slice."""
    scores, letters = model.word_scores(w)
    best, fixed = _constant(scores, w.bounds, penalty)
    path = np.repeat(best, w.counts()).astype(np.int64)
    todo = np.flatnonzero(~fixed)
    for d, found in zip(todo, _viterbi(scores, w.bounds, todo, penalty) if len(todo) else []):
        path[w.bounds[d] : w.bounds[d + 1]] = found
    return path, letters


def _spans(path: np.ndarray, w: Words, d: int, names: list[str]) -> list[dict]:
    lo, hi = w.bounds[d : d + 2]
    if lo == hi:
        return []
    cut = np.concatenate([[0], np.flatnonzero(np.diff(path[lo:hi])) + 1, [hi - lo]])
    return [{"first": int(a), "end": int(b), "lang": names[path[lo + a]]} for a, b in zip(cut[:-1], cut[1:])]


def _main(model: LanguageModel, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(main language, its share of letters, letters) of each text of a slice, and each word's language."""
    path, letters = label_words(model, w)
    n, k = w.hi - w.lo, len(model.languages)
    by = np.bincount(w.text_of() * k + path, letters, n * k).reshape(n, k) if len(path) else np.zeros((n, k))
    total, top = by.sum(1), by.argmax(1)
    return top, np.where(total > 0, by[np.arange(n), top] / np.maximum(total, 1), 0.0), total, path


def keep_languages(docs: DataFrame, model: LanguageModel | None, min_share: float) -> DataFrame:
    """The rows of docs, all columns, whose main language holds min_share of their letters or more.  A text
    without a letter goes; without a model nothing does.  Rows are judged as they are read."""
    if model is None:
        return docs

    def emit(batches):
        for batch in batches:
            keep = []
            for w in words_of(batch.column("text"), lower=True):
                _, share, letters, _ = _main(model, w)
                keep.append((letters > 0) & (share >= min_share))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return in_batches(docs, emit, docs.schema)


def predict_languages(docs: DataFrame, model: LanguageModel | None, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of every document.

    lang_pred is the language of most letters, the first in order on a tie; score is its share of all
    letters.  spans lists (first word, end word, language).  A null text, or one without a letter, is
    ``und`` with score 0 and no span, and so is every text where there is no model.  Letters of a
    script that no language writes count for the text's best language.  Each row gives a row; only
    doc_id and text are read.
    """

    def emit(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for w in words_of(batch.column("text"), lower=True):
                n = w.hi - w.lo
                if model is None:
                    names, score, found = ["und"] * n, np.zeros(n), [[]] * n
                else:
                    top, score, total, path = _main(model, w)
                    names = [model.languages[t] if x else "und" for t, x in zip(top, total)]
                    found = [_spans(path, w, d, model.languages) if total[d] else [] for d in range(n)] if spans else []
                out = [ids.slice(w.lo, n), pa.array(names, pa.string()), pa.array(score)]
                if spans:
                    out.append(pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "spans"][: len(out)])

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first: long, end: long, lang: string>>" * spans
    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), emit, schema)
