"""Bit sets of fixed size over 64-bit values, built by aggregation: filters without false negatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnp import mix

_SEED = np.uint64(0x5851F42D4C957F2D)


def places(values: np.ndarray, size: int) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64) ^ _SEED) % np.uint64(size)).astype(np.int64)


def build(values: DataFrame, size: int) -> np.ndarray:
    """A set of ``size`` bits that holds each value of a one-column table of longs."""

    def emit(batches):
        for batch in batches:
            column = batch.column(0).drop_null()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(places(column.to_numpy(), size)) + 1)], ["p"])

    bits = values.mapInArrow(emit, "p long").groupBy(F.bitmap_bucket_number("p").alias("b"))
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)  # bitmap functions count bits and buckets from 1
    # a partition is a job of the driver's; half a MB each keeps these few, whatever the number of shuffle partitions
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).coalesce(max(1, len(out) >> 19))
    for row in bits.toLocalIterator():
        out[(row.b - 1) * 4096 : row.b * 4096] = np.frombuffer(row.m, np.uint8)
    return out


def holds(bits: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    at = places(values, size)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
