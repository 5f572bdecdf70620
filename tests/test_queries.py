"""Every registered query of the library against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from listingflow.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLES:
        assert df.columns and rows
        return
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canon(rows, df.columns) == canon(cur.fetchall(), names)
