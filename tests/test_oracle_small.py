"""Every registered query against its DuckDB oracle on sf0.001 (the driver
repeats this on sf0.01)."""

import duckdb
import pytest

from conftest import SF_SMALL
from escrowlens import registry
from tools.check_oracle import TABLES, rows_key

QUERIES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql()[name]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_key(df.columns, srows) == rows_key(dcols, res.fetchall())
