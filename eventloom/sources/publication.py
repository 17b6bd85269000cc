"""Publications as immutable Parquet folders with a pointer, and gzip NDJSON artifacts with a content root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.revisions import content_root


def publish(df: DataFrame, root: str, publication_id: str) -> dict:
    """Write a publication; its row count and content root are its manifest.  An id is written once."""
    path = f"{root}/publications/{publication_id}"
    df.write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.parquet(path)
    manifest = content_root(written, written.columns).withColumn("publication_id", F.lit(publication_id))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{root}/manifests/{publication_id}")
    row = manifest.first()
    return {"publication_id": publication_id, "root": row["root"], "rows": row["rows"]}


def activate(spark: SparkSession, root: str, publication_id: str, expected: str | None) -> None:
    """Make a publication the active one if ``expected`` is active now: each activation is a numbered row
    that can be written only once, so of two that race one fails."""
    number, current = active(spark, root)
    if current != expected:
        raise ValueError(f"active is {current}, not {expected}")
    spark.createDataFrame([(number + 1, publication_id)], "number long, publication_id string").coalesce(1).write.mode("errorifexists").json(f"{root}/pointer/{number + 1:012d}")


def active(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, id) of the last activation."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return 0, None
    row = spark.read.schema("number long, publication_id string").json(f"{root}/pointer/*").orderBy(F.desc("number")).first()
    return (row["number"], row["publication_id"]) if row else (0, None)


def read_active(spark: SparkSession, root: str) -> DataFrame:
    """The active publication, after its rows have been held against its manifest."""
    _, publication_id = active(spark, root)
    df = spark.read.parquet(f"{root}/publications/{publication_id}")
    manifest = spark.read.schema("root string, rows long").json(f"{root}/manifests/{publication_id}").first()
    found = content_root(df, df.columns).first()
    if (found["root"], found["rows"]) != (manifest["root"], manifest["rows"]):
        raise ValueError(f"publication {publication_id} does not match its manifest")
    return df


def write_artifact(df: DataFrame, path: str) -> str:
    """Gzip NDJSON of a table; returns the content root of its rows."""
    df.write.mode("errorifexists").option("compression", "gzip").json(path)
    return content_root(df, df.columns).first()["root"]


def read_artifact(spark: SparkSession, path: str, schema, root: str) -> DataFrame:
    df = spark.read.schema(schema).json(path)
    if content_root(df, df.columns).first()["root"] != root:
        raise ValueError("the artifact does not match its root")
    return df
