"""Shared helpers of the training-data operators: scratch tables, sizes, registration data.

Lineage is cut with Parquet tables in the shared folder that the cluster names in
``spark.checkpoint.dir``.  Parquet is columnar and compressed, so it takes a fraction of the
space of an RDD checkpoint and survives lost executors in the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_root

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one file, at most, of a scratch table whose number of rows is known to be bounded.
ROWS_PER_FILE = 50_000


def materialize(df: DataFrame, name: str, rows: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: the cut in the lineage is durable.
    compression: the codec, where the session's own isn't to be used (zstd for whole texts).

    rows is a bound on its number of rows where one is known from a table that it comes from.  Then it
    gets a file for each ROWS_PER_FILE of them at most, so that a small table isn't written by as many
    tasks as the shuffle before it has partitions."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch that a Python worker is given, about; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame, emit: Callable, schema) -> DataFrame:
    """``df.mapInArrow(emit, schema)`` with batches bounded by bytes, so that what a worker and the JVM
    beside it hold at once doesn't depend on how long texts are."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name)).rstrip("b")) != BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(emit, schema)


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when its results have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words (runs of non-white-space) as long; null counts 0."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(
        F.when(F.trim(flat) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(flat), " +"))), F.lit(0)
    ).cast("long")
