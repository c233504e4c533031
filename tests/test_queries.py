"""Each query gives what its SQL gives in another engine."""

import datetime as dt
import decimal
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from terrane import queries

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(BASE):
        con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{BASE}/{t}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, BASE)
    expected = db.sql(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edge_of_a_circle(spark, tmp_path):
    """Points at the buffer's radius from its centre, and next to it."""
    users = {x: (x + 180) * 103 % 360 for x in range(6, 15)}
    at = [(x, y + turn) for x in users for y in (16.99, 17.0, 17.01, 19.99, 20.0, 20.01, 22.99, 23.0, 23.01) for turn in (0.0, 90.0, 450.0)]
    events = spark.createDataFrame([(i, users[x], y) for i, (x, y) in enumerate(at)], "event_id long, user_id long, value double")
    events.selectExpr("*", "timestamp_ntz'2024-01-01' AS ts", "'view' AS event_type", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("function_buffer", "function_st_buffer"):
        df, expected = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.SQL[name])
        assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_one_limit_for_all_collections(spark, db):
    """Also where the first collection alone has more rows than the limit."""
    for limit in (20, 70):
        found = queries.engine(spark, BASE).multi(["large_parts", "orders"], {"properties": "p_name", "limit": str(limit)})
        expected = db.sql(f"SELECT * FROM ({queries.SQL['multi_collection']}) ORDER BY 1, 3, 5 LIMIT {limit}")
        assert [tuple(r) for r in found.collect()] == expected.fetchall()


_APART = """
import sys
from pyspark.sql import SparkSession
from terrane import queries

conf = {"spark.checkpoint.dir": f"file://{sys.argv[1]}/shared", "spark.executor.memory": "512m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
print("found", sorted(r.s_suppkey for r in queries.QUERIES["jdbc_scan"](spark, sys.argv[2]).collect()))
"""


def test_executors_apart(db, tmp_path):
    """The database is read by processes that don't share the driver's memory."""
    ran = subprocess.run([sys.executable, "-c", _APART, str(tmp_path), BASE], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    keys = sorted(r[0] for r in db.sql(queries.SQL["jdbc_scan"]).fetchall())
    assert f"found {keys}" in ran.stdout, ran.stderr[-2000:]
    assert not list((tmp_path / "shared").rglob("*.jar"))  # gone with the process
