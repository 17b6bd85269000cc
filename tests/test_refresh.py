"""Incremental publications: what is rewritten, what is carried, and batches that come again; and trees of chunks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from eventloom.operators import revisions
from eventloom.sources import refresh

SCHEMA = "k long, v string"


@pytest.fixture()
def root(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(40)], SCHEMA)
    refresh.publish_whole(rows, str(tmp_path), "whole", F.col("k") % 8)
    return str(tmp_path)


def rows_of(spark, root, name):
    return {r.k: (r.v, r.publication) for r in refresh.read(spark, root, name, SCHEMA).collect()}


def test_one_changed_session_rewrites_its_partition(spark, root):
    changes = spark.createDataFrame([(3, "new"), (12, "v12"), (100, "more")], SCHEMA)
    assert refresh.refresh(changes, root, "whole", "next", "k", F.col("k") % 8) == "next"
    got = rows_of(spark, root, "next")
    assert got[3] == ("new", "next") and got[100] == ("more", "next") and len(got) == 41
    assert {k for k, (_, p) in got.items() if p == "next"} == {k for k in got if k % 8 in (3, 4)}
    assert sorted(os.path.basename(p) for p in glob.glob(f"{root}/rows/next/part=*")) == ["part=3", "part=4"]
    assert {tuple(r) for r in refresh.outbox(spark, root).select("session", "what", "publication").collect()} == {("3", "changed", "next"), ("100", "added", "next")}
    assert rows_of(spark, root, "whole")[3] == ("v3", "whole")


def test_a_refresh_without_a_change_leaves_the_base(spark, root):
    same = spark.createDataFrame([(3, "v3"), (12, "v12")], SCHEMA)
    assert refresh.refresh(same, root, "whole", "next", "k", F.col("k") % 8) == "whole" and not glob.glob(f"{root}/parts/next")


def test_batches_that_come_again_count_once(spark, root):
    sink = refresh.refresh_sink(root, "whole", "k", F.col("k") % 8)
    first, second = (spark.createDataFrame([(3, v)], SCHEMA) for v in ("a", "b"))
    for number, batch in ((0, first), (0, first), (1, second), (0, first), (1, second), (2, second)):
        sink(batch, number)
    assert rows_of(spark, root, "refresh-1")[3] == ("b", "refresh-1") and rows_of(spark, root, "refresh-2") == rows_of(spark, root, "refresh-1")
    assert refresh.outbox(spark, root).count() == 2


def test_damaged_chunks_are_named_alone(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(95)], SCHEMA)
    tree = revisions.chunk_tree(df, "k", 10, ["k", "v"])
    levels = {r.level: r.c for r in tree.groupBy("level").agg(F.count("*").alias("c")).collect()}
    assert levels == {0: 10, 1: 5, 2: 3, 3: 2, 4: 1} and tree.where("level = 4").first().rows == 95
    hurt = df.withColumn("v", F.when(F.col("k") == 41, "x").otherwise(F.col("v"))).where("k BETWEEN 30 AND 59")
    assert [r.n for r in revisions.damaged_chunks(hurt, tree, "k", 10, ["k", "v"]).collect()] == [4]
