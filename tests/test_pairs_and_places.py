"""What pairs of a nation and places of customers cost."""

from eventloom.catalog import extra, ingest


def test_pairs_of_one_nation_are_dealt_to_several_tasks(spark, tmp_path):
    rows = [(i, f"Supplier#{i // 2:05d}{'x' * (i % 2)}", 3, float(i * 997 % 12000)) for i in range(300)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    out = extra.pair_decisions(spark, str(tmp_path))
    assert "part" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.s_suppkey, r.s_suppkey2): r.rule for r in out.collect()}

    def near(a, b):  # one edit at most
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    name = lambda n: n.replace("#", "").lower()
    want = {
        (x, y): "balance" if abs(p - q) > 5000 else "title" if near(name(m), name(n)) else "seed" if abs(p - q) < 100 else "none"
        for x, m, _, p in rows for y, n, _, q in rows if x < y
    }
    assert got == want and set(want.values()) == {"balance", "title", "seed", "none"}


def test_equal_labels_and_addresses_are_read_once(spark, tmp_path):
    spark.range(700).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    out = ingest.location_resolve(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    assert sum(r.n for r in out.collect()) == 700
