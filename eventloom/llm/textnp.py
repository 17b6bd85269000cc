"""Vectorised words and word windows of Arrow text columns.

The functions here work on the UTF-8 bytes of a slice of an Arrow batch: no Python object is made
for a word.  Texts are taken in slices of about ``SLICE`` bytes (a longer text is a slice of its
own), so the memory of a task is bounded by the slice and the longest single text.

Words are told apart by 64-bit hashes: two different words are taken as equal with a chance of 2**-64
for each pair, whatever is built on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
#: Words of more bytes are hashed as a whole: sums modulo 2**64 can't tell some long words apart that repeat
#: two letters in the Thue-Morse order (from 1024 bytes on).
LONG_WORD = 256
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and all other ASCII but letters and digits: what parts terms.
_NO_TERM = np.array([not (b > 127 or chr(b).isalnum()) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _table(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds, the same wherever the span stands."""
    sums = _sums(values, base)
    return mix((sums[end] - sums[start]) * _table(base, len(values) + 1)[1][start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of the texts lo..hi of a batch: bytes, byte bounds and hash of each word, and the
    bounds of each text in the words."""

    lo: int
    hi: int
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts())

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of so many words that lies in one text."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.bounds[1:], self.counts()) - np.arange(n)
        at = np.flatnonzero(left >= length)
        return at, span_hashes(self.hashes, _STEP, at, at + length)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(at):
        at = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words_of(column: pa.Array, lower: bool = False, terms: bool = False) -> Iterator[Words]:
    """The words of each slice of a text column.  lower: A-Z as a-z before hashing; terms: runs of
    letters, digits and other characters beyond ASCII instead of runs of anything but white space."""
    apart = _NO_TERM if terms else _SPACE
    offsets, raw = text_bytes(column)
    for lo, hi in slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        data = raw[offsets[lo] : offsets[hi]]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~apart[data]
        begins, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        edge = at[(at > 0) & (at < len(data))]  # a word never runs on into the next text
        edge = edge[inside[edge + 1] & inside[edge]]
        begins[edge] = True
        ends[edge] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        folded = LOWER[data] if lower else data
        hashes = span_hashes(_BYTE[folded], _BASE, start, end)
        for k in np.flatnonzero(end - start > LONG_WORD):
            hashes[k] = int.from_bytes(blake2b(folded[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        yield Words(lo, hi, data, at, start, end, hashes, np.searchsorted(start, at))
