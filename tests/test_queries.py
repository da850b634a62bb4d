"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from gapwise import plans
from tools.compare import TABLES, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    if name in plans.SQL:
        rel = con.execute(plans.SQL[name])
        assert got == rows([d[0] for d in rel.description], rel.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
