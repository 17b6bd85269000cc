"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, jaccard, langid, lines, mixing
from eventloom.llm.common import scratch_root, table

#: A text is rejected if its main language holds a smaller share of its letters.
MIN_LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; texts without a letter, or without a main language, go."""
    return langid.keep_languages(docs, langid.fit_languages(docs, label="lang"), MIN_LANGUAGE_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate lines; n_chars follows the text."""
    out = lines.dedup_lines(docs, site="source")
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the least doc_id.
    Rows without a doc_id stay.  Where a doc_id has several texts, its links are those of all of them, so
    of these only the texts go that equal one of a smaller doc_id, and no other text is lost."""
    groups = jaccard.jaccard_components(docs, k=5, num=80, den=100)
    texts = groups.groupBy("doc_id").agg((F.min("text_hash") != F.max("text_hash")).alias("several"))
    copies = groups.where("component_id < doc_id").join(texts, "doc_id").where("copy_of < doc_id OR NOT several")
    copies = copies.select(F.col("doc_id").alias("copy"), F.col("text_hash").alias("copy_hash")).distinct()
    is_copy = (docs["doc_id"].cast("long") == copies["copy"]) & (F.xxhash64(docs["text"]) == copies["copy_hash"])
    return docs.join(copies, is_copy, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
]

#: Language ID, edit-distance search and their models can't be expressed in SQL; tests/llm hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared scratch folder and reread."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
