"""Every registered query against its DuckDB oracle on sf0.001 (row count,
column names, order-insensitive values)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from promptloom.sources.tables import TABLES
from tools.check_oracle import rows_of

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    s_rows, s_cols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(ORACLES[name])
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert rows_of(s_rows, s_cols) == rows_of(o_rows, o_cols)


def test_every_query_has_oracle_or_test():
    without = set(QUERIES) - set(ORACLES)
    assert {n for n in without if n.startswith("q")} == set()


def test_entry_runs(spark):
    assert E.entry(spark).count() == 2
