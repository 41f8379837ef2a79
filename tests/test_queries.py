"""Every registered core query runs over the smallest tables and, where it has SQL, agrees with it."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of

CORE = {n: q for m in entry.MODULES for n, q in m.QUERIES.items()}
CHECKS = {n: s for m in entry.MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(small):
    import os

    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, small, con, name):
    df = CORE[name](spark, small)
    got = rows_of(df.columns, df.collect())
    if name in CHECKS:
        cur = con.execute(CHECKS[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
