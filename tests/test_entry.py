"""The driver's contract, and every catalogued query against DuckDB on the smallest data."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue, more  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = [r.asDict() for r in df.collect()]
    if name not in catalogue.SQL:
        assert df.columns
        return
    cur = db.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: str(r)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in order) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=key) == want
