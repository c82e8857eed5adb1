"""The registered box-score and star queries against their SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lakeloom.plans import checked_box, checked_reads, checked_star

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")
PLAIN = checked_box.QUERIES | checked_reads.QUERIES | checked_star.QUERIES


def same(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def duck(sql):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    r = con.execute(sql)
    return [c[0] for c in r.description], r.fetchall()


@pytest.mark.parametrize("name", [n for n, (_, sql) in PLAIN.items() if sql])
def test_matches_sql(spark, name):
    df = entry.queries()[name](spark, DIR)
    cols, rows = duck(entry.oracle_sql()[name])
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert sorted(tuple(map(same, r)) for r in df.collect()) == sorted(tuple(same(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in PLAIN.items() if not sql])
def test_runs(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
