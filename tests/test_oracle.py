"""Registered queries: a few compared with DuckDB here; tools/check.py compares all of them."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, _rows

DATA = "/root/testdata/sf0.001"
NAMES = ["T3_extract_links", "C3_sections", "W10_cell_context", "E9_gold_evidence", "R2_bm25_topk", "G5_execute_programs", "V6_sari", "D4_tiered_reward"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    want = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got and got == _rows(columns, want.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
