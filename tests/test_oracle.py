"""Every registered query against its DuckDB twin on the smallest scale (rows, columns, values)."""

import duckdb
import pytest

from tools.check_oracle import TABLES, rows_of, type_mismatches
from tripleval.plans import registry

KEYS = sorted(registry.queries())
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_dir, con, key):
    df = registry.queries()[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if key not in SQL:
        assert len(df.columns) > 0
        return
    cur = con.execute(SQL[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert type_mismatches(df, con.sql(SQL[key])) == {}
    assert rows_of(df.columns, rows) == rows_of(cols, cur.fetchall())
