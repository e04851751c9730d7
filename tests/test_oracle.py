"""Every registered query against its DuckDB twin on the same parquet
tables (sf0.001 by default; set LEDGERLENS_TEST_SF for another scale)."""

import pytest

import __spark_entry__ as E
from ledgerlens.compare import compare, duckdb_connection
from ledgerlens.registry import ORACLE_SQL as ORACLE
from ledgerlens.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_small):
    return duckdb_connection(sf_small)


def test_entry_registers_every_query():
    assert QUERIES.items() <= E.queries().items() and ORACLE.items() <= E.oracle_sql().items()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, sf_small, con, name):
    r = compare(spark, sf_small, name, QUERIES[name], ORACLE[name], con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert df.columns == ["leakage_type", "record_count", "amount_at_risk", "description", "pct_of_total_risk"]
