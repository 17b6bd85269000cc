"""Incremental publications: a change set rewrites the partitions of the sessions that changed, all others are carried.

A publication is a table of (part, publication): which publication's folder holds each partition.  A refresh
writes new folders for the partitions that hold a changed session, a new table of parts, and one outbox row
for each changed session; the table of parts is written last, once, and makes the refresh visible.  A
refresh that is run again finds its table and does nothing, so a stream's batches count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "part long, publication string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _parts(spark: SparkSession, root: str, publication: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{root}/parts/{publication}")


def publish_whole(rows: DataFrame, root: str, publication: str, part: Column) -> None:
    """A first publication of all rows, in folders by part."""
    rows.withColumn("part", part.cast("long")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/rows/{publication}")
    spark = rows.sparkSession
    held = spark.read.parquet(f"{root}/rows/{publication}").select(F.col("part").cast("long").alias("part")).distinct()
    held.select("part", F.lit(publication).alias("publication")).write.mode("errorifexists").parquet(f"{root}/parts/{publication}")


def read(spark: SparkSession, root: str, publication: str, schema, parts: list[int] | None = None) -> DataFrame:
    """The rows of a publication, with part and the publication that wrote it; only some parts if given."""
    held = _parts(spark, root, publication)
    held = held.where(F.col("part").isin(parts)) if parts is not None else held
    folders = [r.publication for r in held.select("publication").distinct().collect()]  # as many as refreshes that still hold a part
    out = None
    for name in folders:
        own = [r.part for r in held.where(F.col("publication") == name).collect()]  # as many as parts, a number that is fixed
        rows = spark.read.schema(schema).option("basePath", f"{root}/rows/{name}").parquet(*(f"{root}/rows/{name}/part={p}" for p in own)).withColumn("publication", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], schema).withColumns({"part": F.lit(None).cast("long"), "publication": F.lit(None).cast("string")})


def refresh(changes: DataFrame, root: str, base: str, publication: str, key: str, part: Column) -> str:
    """The publication after ``changes`` (whole rows, one for each key) over the base; its id, or the base's if no row differs.

    Rows that equal the base's change nothing.  Only parts with a changed key are read and written."""
    spark = changes.sparkSession
    if _exists(spark, f"{root}/parts/{publication}/_SUCCESS"):
        return publication
    content = [c for c in changes.columns if c != key]
    same = lambda a, b: " AND ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in content)
    own = changes.withColumn("part", part.cast("long"))
    touched = [r.part for r in own.select("part").distinct().collect()]  # as many as parts
    old = read(spark, root, base, changes.schema, touched)
    differs = own.alias("n").join(old.alias("o"), [key], "left").where(f"o.part IS NULL OR NOT ({same('n', 'o')})")
    changed = differs.select(key, *(F.col(f"n.{c}").alias(c) for c in content), F.col("n.part").alias("part"), F.col("o.part").isNull().alias("new")).persist()
    try:
        parts = [r.part for r in changed.select("part").distinct().collect()]
        if not parts:
            return base
        carried = old.where(F.col("part").isin(parts)).join(changed.select(key), key, "left_anti").select(*changes.columns, "part")
        carried.unionByName(changed.select(*changes.columns, "part")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/rows/{publication}")
        outbox = changed.select(F.lit(publication).alias("publication"), F.col(key).cast("string").alias("session"), F.when(F.col("new"), "added").otherwise("changed").alias("what"))
        outbox.write.mode("overwrite").parquet(f"{root}/outbox/publication={publication}")
        held = _parts(spark, root, base).where(~F.col("part").isin(parts)).unionByName(spark.createDataFrame([(p, publication) for p in parts], PARTS))
        held.coalesce(1).write.mode("overwrite").parquet(f"{root}/parts/{publication}")
        return publication
    finally:
        changed.unpersist()


def refresh_sink(root: str, first: str, key: str, part: Column, name: str = "refresh") -> Callable[[DataFrame, int], None]:
    """A stream's sink: batch n refreshes what the batch before it left.  The id is the batch's number, so a batch that is
    delivered again changes nothing; a batch without a change leaves a copy of the table of parts."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base, own = f"{name}-{number - 1}" if number else first, f"{name}-{number}"
        if refresh(batch, root, base, own, key, part) == base:
            _parts(spark, root, base).coalesce(1).write.mode("overwrite").parquet(f"{root}/parts/{own}")

    return sink


def outbox(spark: SparkSession, root: str) -> DataFrame:
    """(publication, session, what) of all refreshes that are visible."""
    return spark.read.schema("session string, what string, publication string").option("basePath", f"{root}/outbox").parquet(f"{root}/outbox")
