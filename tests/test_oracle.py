"""Every registered query agrees with its DuckDB oracle on the driver's
sf0.001 fixtures: row count, column names and values (order-insensitive)."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest

from conftest import TESTDATA

import __spark_entry__ as E
from fanscope.plans.queries import registry

SF = os.path.join(TESTDATA, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="fixtures not present")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("region", "nation", "customer", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(registry()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    assert len(got) == len(want)
    assert canon(got, df.columns) == canon(want, o_cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["like_id", "name", "type", "score", "n_likers"]
    assert df.count() == 50


def test_entry_survives_a_session_restart():
    """The per-session pipeline cache must not touch a stopped session."""
    import subprocess
    import sys
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as E\n"
        "b = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')\n"
        "s1 = b.getOrCreate(); n1 = E.entry(s1).count(); s1.stop()\n"
        "s2 = b.getOrCreate(); n2 = E.entry(s2).count(); s2.stop()\n"
        "print('ROWS', n1, n2)\n" % os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert "ROWS 50 50" in out.stdout, out.stderr[-2000:]
