"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from surgelight.plans import registry


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert got
        return
    cursor = con.execute(registry.ORACLES[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    want = sorted((tuple(_plain(row[order.index(c)]) for c in columns) for row in cursor.fetchall()), key=repr)
    assert got == want


def test_flagship_has_rows(spark, data):
    assert registry.flagship(spark, data).count() > 0
