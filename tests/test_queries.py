"""Every registered query against its SQL in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import DATA

from vaultflow import registry


def norm(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return str([norm(v) for v in x])
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE:
        assert rows
        return
    cur = duck.execute(registry.ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in rows) == want
