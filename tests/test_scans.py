"""Ordered folds, as-of reads and percentiles against plain Python, with one hot key."""

import bisect
import math
import random

from pyspark.sql import functions as F

from eventloom.operators import scans
from eventloom.scratch import cut


def table(spark, seed=1, n=600):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randrange(50), rng.choice([None, rng.randrange(9)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, id int, t int, x int").repartition(3)


def test_scan_equals_plain_folds(spark):
    rows, df = table(spark)
    x = F.col("x")
    got = scans.scan(df, "k", ["t", "id"], {f: (f, x) for f in ("lag", "lead", "last", "sum", "max", "max_before")}, cut, parts=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by.setdefault(r[0], []).append(r)
    want = {}
    for own in by.values():
        for i, r in enumerate(own):
            known = [o[3] for o in own[: i + 1] if o[3] is not None]
            past = [o[3] for o in own[:i] if o[3] is not None]
            want[r[1]] = (own[i - 1][3] if i else None, own[i + 1][3] if i + 1 < len(own) else None, known[-1] if known else None, sum(known) if known else None, max(known, default=None), max(past, default=None))
    assert {r.id: (r.lag, r.lead, r["last"], r["sum"], r["max"], r.max_before) for r in got} == want


def test_as_of_equals_a_search(spark):
    rng = random.Random(4)
    versions = [("hot", t, f"v{t}") for t in sorted(rng.sample(range(1000), 200))] + [("a", 5, "x")]
    probes = [(rng.choice(["hot", "hot", "a", "none"]), rng.randrange(1000), i) for i in range(300)]
    got = scans.as_of(spark.createDataFrame(versions, "k string, start int, v string"), spark.createDataFrame(probes, "k string, at int, id int"), "k", "start", "at", cut)
    starts = {k: [v[1] for v in versions if v[0] == k] for k in ("hot", "a", "none")}
    want = {}
    for k, at, i in probes:
        n = bisect.bisect_right(starts[k], at)
        want[i] = starts[k][n - 1] if n else None
    assert {r.id: r.start for r in got.collect()} == want


def test_percentiles_equal_sorted_lists(spark):
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.random() * 1000, 7.0])) for _ in range(6000)] + [("b", float(i)) for i in range(10)] + [("b", None), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)
    got = {(r.k, r.share): r.v for r in scans.percentiles(df, "k", "v", shares, cut, lookup=200).collect()}
    want = {}
    for k in ("hot", "b", None):
        own = sorted(v for g, v in rows if g == k and v is not None)
        for s in shares:
            want[k, s] = own[max(1, math.ceil(s * len(own) - 1e-9)) - 1]
    assert got == want
