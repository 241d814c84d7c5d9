"""Every registered query against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from statloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def same(a, b):
    """Equal, or a rounding apart where a sum was added up in another order."""
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1.0, abs(a)) + 1.1e-8


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(map(cell, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    result = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(cell(r[k]) for k in at) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))
