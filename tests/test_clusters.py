"""Constrained clustering against the sequential process."""

import os
import random
import time
from collections import defaultdict

import pytest

from eventloom.operators.clusters import constrained_clusters
from eventloom.scratch import cut


def greedy(n, edges, exclusive, unique, conflicts):
    cluster = {i: i for i in range(n)}
    members = {i: {i} for i in range(n)}
    values, once = defaultdict(dict), defaultdict(set)
    for i, k, v in exclusive:
        values[i][k] = v
    for i, v in unique:
        once[i].add(v)
    bad = {frozenset(p) for p in conflicts}
    for _, a, b in sorted((p, min(a, b), max(a, b)) for a, b, p in edges):
        x, y = cluster[a], cluster[b]
        if x == y or any(values[x].get(k, v) != v for k, v in values[y].items()) or once[x] & once[y]:
            continue
        if any(frozenset((p, q)) in bad for p in members[x] for q in members[y]):
            continue
        keep, gone = min(x, y), max(x, y)
        for m in members[gone]:
            cluster[m] = keep
        members[keep] |= members.pop(gone)
        values[keep] |= values[gone]
        once[keep] |= once[gone]
    return cluster


def run(spark, n, edges, exclusive=None, unique=None, conflicts=None):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = constrained_clusters(
        frame([(i,) for i in range(n)], "id long"), frame(edges, "a long, b long, priority int"), "id", cut,
        frame(exclusive, "id long, key string, value string") if exclusive is not None else None,
        frame(unique, "id long, value string") if unique is not None else None,
        frame(conflicts, "a long, b long") if conflicts is not None else None,
    )
    return {r.id: r.cluster for r in out.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_the_sequential_process(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(6)) for _ in range((80, 200, 45)[seed])]
    exclusive = [(i, k, rng.choice("vw")) for i in range(n) for k in "pqr" if rng.random() < 0.25]
    unique = [(i, rng.choice("ABCDEFGHIJ")) for i in range(n) if seed and rng.random() < 0.4]
    conflicts = [(rng.randrange(n), rng.randrange(n)) for _ in range(30)] if seed != 1 else []
    conflicts = [p for p in conflicts if p[0] != p[1]]
    assert run(spark, n, edges, exclusive, unique, conflicts) == greedy(n, edges, exclusive, unique, conflicts)


def test_star_and_chain_of_a_large_block(spark):
    """A block linked by its least member and by neighbours, of three values: few rounds, whatever its size."""
    n = 2000
    edges = [(0, i, 2) for i in range(1, n)] + [(i - 1, i, 2) for i in range(1, n)]
    exclusive = [(i, "venue", str(i % 3)) for i in range(0, n, 2)]
    assert run(spark, n, edges, exclusive) == greedy(n, edges, exclusive, [], [])


def test_edges_of_clusters(spark):
    assert run(spark, 3, []) == {0: 0, 1: 1, 2: 2}
    assert run(spark, 3, [(1, 1, 0), (None, 2, 0), (2, 1, 5), (1, 2, 1)]) == {0: 0, 1: 1, 2: 1}
    assert run(spark, 2, [(0, 1, 0)], conflicts=[(1, 0)]) == {0: 0, 1: 1}
    assert run(spark, 0, []) == {}


def test_tables_of_clusters_are_not_sent_through_the_driver(spark):
    from eventloom.operators import clusters

    live = cut(spark.createDataFrame([(1, 2, 0), (2, 3, 1)], "a long, b long, priority int"))
    plan = clusters._trees(clusters._live(live), lambda df: df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rounds_leave_no_tables_behind(spark):
    """Only what names the clusters stays: the tables of a round go when the next has its own."""
    from eventloom.scratch import scratch_root

    root = scratch_root(spark).removeprefix("file://")
    tables = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()
    before, n = tables(), 40
    edges = [(i - 1, i, (i * 7) % 5) for i in range(1, n)]
    exclusive = [(i, "venue", str(i % 3)) for i in range(0, n, 4)]
    assert run(spark, n, edges, exclusive) == greedy(n, edges, exclusive, [], [])
    assert len(tables() - before) <= 1


def test_cut_leaves_no_shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for f in range(found.getAllFiles().size()) if (n := found.getAllFiles().apply(f).getName()).startswith("shuffle_")}
    before = shuffled()
    out = cut(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    until = time.time() + 10
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and out.count() == 7


def test_venue_links_are_dealt_out(spark):
    from eventloom.operators import venues

    rows = [(i, "pq"[i % 2], "c0", ("Salon Moda Sahnesi", "Moda Sahnesi Ek", "Zorlu")[i % 3], f"v{i % 4}", None, 40.99 + i * 1e-4, 29.02, ["kadikoy"] if i % 2 else []) for i in range(30)]
    own = cut(spark.createDataFrame(rows, "id long, provider string, city string, name string, venue_id string, seed string, lat double, lon double, districts array<string>"))
    edges = venues.venue_edges(own)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    links = venues.venue_links(own)
    best = links.groupBy("a", "b").min("priority").collect()
    assert sorted(map(tuple, best)) == sorted((r.a, r.b, r.priority) for r in edges.collect()) and best
