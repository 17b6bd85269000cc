"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, one sub-folder for each application.

    ``spark.checkpoint.dir`` is used where it is set.  Where it is unset, a temporary folder is made,
    but only if all tasks run in this process; on a cluster that is an error, since executors would
    write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='eventloom-')}")
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/eventloom-{spark.sparkContext.applicationId}"


#: Shuffle files go when the query that wrote them ends, and not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it: a durable end of the lineage, which leaves no shuffle files."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/cut-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut has written and that nothing reads any more; other tables stay."""
    for df in tables:
        if df is not None and (path := vars(df).pop("_scratch", None)):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
