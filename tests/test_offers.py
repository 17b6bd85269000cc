from eventloom.catalog import ranking


def test_supplier_of_equal_offers_is_the_least(spark, tmp_path):
    rows = [(1, s, 2, 10.0, 0.1, "N") for s in (3, 5, 9)] + [(2, s, 2, 10.0, 0.1, "N") for s in (9, 5, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.l_orderkey: r.supplier for r in ranking.offer_summary(spark, str(tmp_path)).collect()} == {1: 3, 2: 3}
