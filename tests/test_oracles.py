"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import numpy as np
import pytest

from condensa.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(cell, v))
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, (float, np.floating)) else str(v)


def rows(df):
    return sorted(repr(tuple(map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without SQL, and the tests that hold them against brute force.
BY_HAND = {
    "bootstrap_rouge": "test_pairs", "rouge_corpus": "test_pairs", "keyword_prf_at_k": "test_text", "greedy_aligner": "test_by_hand", "lexrank_st": "test_by_hand", "lexrank_max_length": "test_by_hand",
    "lexrank_dynamic": "test_by_hand", "yake_extract": "test_by_hand", "summarize_by_keyphrases": "test_by_hand",
}


def test_every_query_has_sql_or_a_test_by_hand():
    assert set(QUERIES) - set(ORACLES) == set(BY_HAND)
    for name, module in BY_HAND.items():
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{module}.py")) as f:
            assert f'"{name}"' in f.read()
