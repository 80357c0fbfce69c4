"""Every query of the engine against DuckDB on the driver's smallest tables."""

import duckdb
import pytest

from millrace.queries import ORACLE_SQL, QUERIES
from millrace.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    found = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
