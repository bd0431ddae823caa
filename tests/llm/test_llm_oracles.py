import os

import pytest

from condensa.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    out = QUERIES[name](spark, DATA)
    assert sorted(out.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in out.collect())
    assert rows == sorted(want.fetchall()) and rows
