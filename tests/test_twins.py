"""Every query with an SQL twin against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db(folder):
    c = duckdb.connect()
    for t in os.listdir(folder):
        p = f"{folder}/{t}"
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, folder, db, name):
    df = entry.queries()[name](spark, folder)
    r = db.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(norm(x[cols.index(c)]) for c in order) for x in r.fetchall()), key=str)
    assert sorted((tuple(norm(x[c]) for c in order) for x in df.collect()), key=str) == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
