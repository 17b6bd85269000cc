"""Target-distribution importance resampling over hashed word n-grams (operator 13).

Features of a text are its runs of 1 to n consecutive words.  A ring holds the zlib CRC-32 states of the
last n starts: each word extends every state by a space and the word and opens a new one, so one scan of
a text emits the buckets of all its runs, and no run is ever put together as a string.  A bucket's gain
is the log ratio of its smoothed shares in the target and in the corpus; a document's weight is the mean
gain of its features; Gumbel noise hashed from its id turns the weights into a draw without replacement
of fixed size.

Texts are scanned once, to a scratch table of buckets.  What is gathered is one count for each bucket;
documents are ranked within ranges of their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.search import ranked
from .common import in_batches, materialize

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Gains and noise are whole thousandths.
UNITS = 1000
#: Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text; a null has none."""
    return (text or b"").translate(_FOLD).split()


def crc_ring(words: list[bytes], ngram: int) -> list[int]:
    """CRC-32 of every run of 1 to ngram words, joined by a space, in order of the runs' last words."""
    ring: list[int] = []
    out: list[int] = []
    for word in words:
        ring = [crc32(word, crc32(b" ", state)) for state in ring[max(0, len(ring) - ngram + 1) :]]
        ring.append(crc32(word))
        out += ring
    return out


def bucket_rows(texts: DataFrame, ngram: int, buckets: int, key: str | None = None) -> DataFrame:
    """([key,] n_words, buckets) of each row: the buckets of all features of its text."""
    own = texts.select(*([F.col(key).alias("key")] if key else []), F.col("text").cast("string").alias("text"))
    kind = f"key {own.schema['key'].dataType.simpleString()}, " if key else ""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts, found = [0], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                found.append((np.array(crc_ring(words, ngram), np.int64) % buckets).astype(np.int32))
                counts.append(len(words))
                at.append(at[-1] + len(found[-1]))
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            names = (["key"] if key else []) + ["n_words", "buckets"]
            yield pa.RecordBatch.from_arrays([*([batch.column("key")] if key else []), pa.array(counts, pa.int64()), lists], names=names)

    return in_batches(own, scan, f"{kind}n_words long, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int) -> dict[int, int]:
    """Features of each bucket over all rows; a task gives one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    counts = in_batches(rows.select("buckets"), count, "bucket int, n long")
    return {r.bucket: r.n for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # one row for each bucket


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * ln of (t + 1) / (T + buckets) over (s + 1) / (S + buckets)) of every bucket."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = lambda b: float((target.get(b, 0) + 1) * s_all) / float((corpus.get(b, 0) + 1) * t_all)
    return np.array([math.floor(UNITS * math.log(ratio(b))) for b in range(buckets)], np.int64)


def gumbel(doc_id: Column, seed: str) -> Column:
    """Thousandths of a Gumbel variate from the first 32 bits of SHA-256 of seed:id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-UNITS * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document.

    target: the texts (column text) whose distribution is aimed at.  Of the N documents with min_words or
    more, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller doc_id; rank counts
    them from 1, and is null for all others.  A null or empty text has no features and weight 0.  A null
    doc_id is drawn by the seed alone and comes last among ties; repeated rows are documents of their own
    with equal scores.  An empty target counts as uniform.  Further columns are ignored.
    """
    rows = materialize(bucket_rows(docs, ngram, buckets, key="doc_id"), "buckets")
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(bucket_rows(target, ngram, buckets), buckets), buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy()])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["key"].dataType.simpleString()
    weighed = in_batches(rows, weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumns({"short": F.col("n_words") < min_words, "row": F.monotonically_increasing_id()})
    # row only parts equal rows, so that many copies of one don't meet in a range
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ranked(scored, order, parts, lambda df: materialize(df, "ranges"))
    drawn = percent * rows.where(F.col("n_words") >= min_words).count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
