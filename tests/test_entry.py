"""The entry module, and every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in os.listdir(DIR):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return db


def _plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert got == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["predicate", "statements", "objects"]
    assert df.count() == 5
