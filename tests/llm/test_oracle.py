"""The operators' queries against their SQL in DuckDB on the smallest tables."""

import os

import pytest

pytest.importorskip("eventloom.llm")
from eventloom.llm.queries import ORACLE, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df, result = QUERIES[name](spark, DATA), duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    place = [df.columns.index(n) for n in names]
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    assert sorted([text(r[i]) for i in place] for r in df.collect()) == sorted([text(v) for v in r] for r in result.fetchall())
