"""Structured Streaming forms of the stateful operators.  Every job ends once its input is read
(availableNow), so that the same code serves batches and tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files of a folder, with event time as an instant."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def rate_windows(events: DataFrame, key: str, width: str, late: str) -> DataFrame:
    """Requests per key and tumbling window; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", width)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def session_windows(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def fresh_once(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first observation of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def land(path: str) -> Callable[[DataFrame, int], None]:
    """Sink: a log of all rows; a batch that is run again replaces its own rows."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def page_heads(log: DataFrame, parts: int, checkpoint) -> DataFrame:
    """(key, id, verdict) of a log of (key, id, arrival, clock, content): the page head machine in order of
    arrival, whichever files and triggers rows came in.  Accepted if newer, stale if older, held on an equal
    clock with other content, same with equal content.

    Rows are dealt to ranges of key and arrival, which checkpoint(df) fixes, so that a hot key takes many
    tasks; what a range starts from is the head that the key's ranges before leave."""
    dealt = checkpoint(log.repartitionByRange(parts, "key", "arrival").withColumn("_range", F.spark_partition_id()))
    head = F.max(F.struct(F.col("clock").alias("c"), (-F.col("arrival")).alias("a"), F.col("content").alias("x")))
    before = Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("key", "_range").agg(head.alias("h")).select(F.col("key"), F.col("_range"), F.max("h").over(before).alias("h"))
    past = Window.partitionBy("key", "_range").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("content").over(Window.partitionBy("key", "_range", "clock").orderBy("arrival"))
    rows = dealt.withColumn("_top", F.max("clock").over(past)).withColumn("_first", first).join(carried, ["key", "_range"])
    top = F.greatest("_top", "h.c")
    first = F.when(F.col("clock") == F.col("h.c"), F.col("h.x")).otherwise(F.col("_first"))
    verdict = F.when(top.isNull() | (F.col("clock") > top), "accepted").when(F.col("clock") < top, "stale").when(F.col("content") == first, "same").otherwise("held")
    return rows.select("key", "id", verdict.alias("verdict"))


def upsert_latest(spark: SparkSession, path: str, key: str, clock: str, tie: str) -> Callable[[DataFrame, int], None]:
    """Sink: a table of the latest row of each key.  Each batch writes the next version beside the last, so a
    batch that is run again finds what it read before."""
    from ..operators.ranking import latest_wins

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        latest_wins(rows, [key], clock, tie).write.mode("overwrite").parquet(f"{path}/v{number}")

    return sink
