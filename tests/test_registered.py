"""The registered queries of the reader against their SQL."""

import glob
import os

import duckdb
import pytest

import sav_checks
import sav_queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = sav_queries.QUERIES | sav_checks.QUERIES, sav_queries.ORACLES | sav_checks.ORACLES


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(sav_checks.QUERIES) + ["vls_documents", "charset_1252", "scan_bytecode", "pricing_summary_zsav"])
def test_same_as_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SF).toArrow(), tables.sql(ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)

    def rows(t):
        return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r.values()]) for r in t.select(names).to_pylist())

    assert rows(got) == rows(want)
