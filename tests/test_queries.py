import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.core.QUERIES]


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = entry.core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in entry.core.SQL:
        assert got
        return
    cur = duck.execute(entry.core.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
