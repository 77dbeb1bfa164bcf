"""Registered queries on small tables made to be odd, against their SQL."""

from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry

pa = pytest.importorskip("pyarrow")
pq = pytest.importorskip("pyarrow.parquet")


def _day(n):
    return None if n is None else datetime(2000, 1, 1) + timedelta(days=n)


def _notes(rows):
    columns = [pa.array(c, t) for c, t in zip(zip(*[(k, p, n, _day(day)) for k, p, n, day in rows]), (pa.int64(), pa.int64(), pa.int32(), pa.timestamp("us")))]
    return pa.table(columns, ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate"])


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_last_note_of_ties_and_nulls(spark, tmp_path, broadcast):
    """Ties within a file, across files and of line with part; no date, no part, no key, no notes. The first in the table's order counts."""
    duckdb = pytest.importorskip("duckdb")
    pq.write_table(pa.table({"o_orderkey": pa.array(range(1, 10), pa.int64()), "o_custkey": pa.array(range(11, 20), pa.int64())}), tmp_path / "orders.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    few = [(1, 5, 7, 3), (1, 5, 7, 9), (1, 5, 7, 1), (1, 6, 2, 4), (2, 5, 7, 8), (3, 100007, 1, 6), (4, 5, 1, 2), (4, 5, 2, None), (5, 5, 1, None), (6, None, 7, 2), (6, 5, 1, 3), (7, None, 1, 4), (None, 5, 1, 5)]
    more = [(2, 5, 7, 1), (2, 5, 7, 30), (3, 7, 2, 2), (8, 5, 4, None), (8, 5, 4, 6), (8, 5, 4, 5)]
    pq.write_table(_notes(few), tmp_path / "lineitem.parquet/a.parquet")
    pq.write_table(_notes(more + [(90 + i, i, 1, i) for i in range(5000)]), tmp_path / "lineitem.parquet/b.parquet")  # larger, so Spark reads it first

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {tuple(r) for r in entry.queries()["statement_annotations"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(4, 3), (3, 8), (2, 6), (2, 2), (1, None), (2, 3), (1, None), (3, 6), (0, None)]
    assert got == {(k, k + 10, n, _day(day)) for k, (n, day) in enumerate(want, 1)}

    db = duckdb.connect()
    db.execute("SET threads = 1")  # the SQL leaves ties open: more threads give other rows
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(db.execute(entry.oracle_sql()["statement_annotations"]).fetchall())
