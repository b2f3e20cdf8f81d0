"""Every query with an SQL twin gives the twin's rows, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from trustloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_twin(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    cur = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=repr)
    assert ours == theirs
