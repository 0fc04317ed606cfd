"""Every registered query of the library against its oracle SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tallyglass.plans import load
from tallyglass.registry import ORACLES, QUERIES

load()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


def order(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    if name not in ORACLES:
        assert got
        return
    r = db.execute(f"select * from ({ORACLES[name]})")
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=order)


def test_names_cover_the_inventory():
    from tallyglass.dims import NINE_TABLES

    assert len(NINE_TABLES) == 9
    assert len(QUERIES) > 150
