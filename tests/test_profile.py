"""Typed profiles against the cell table's, bitmaps among them, and overlaps whose pairs sketches leave out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trustloom.operators import graph as G
from trustloom.operators import profile as P
from trustloom.sources import tables as S


def table(spark, n=400):
    draw = random.Random(4)
    rows = [
        (i - 150, draw.choice([7, -3, None, 10**17, -(10**17)]), draw.choice([1.5, 0.1 + 0.2, 0.3, -2.25, None, 1e-7, 123456.789]), draw.choice(["", None, " x", "2024-01-01", "9"]), dt.datetime(2024, 1, 1, 0, 0, i % 50), dt.date(2000, 1, 1 + i % 20), i % 2 == 0, str(i))
        for i in range(n)
    ]
    return spark.createDataFrame(rows + rows[:3], "id long, few long, ratio double, word string, at timestamp, day date, flag boolean, name string")


@pytest.mark.parametrize("many", [P.MANY, 1])
def test_like_the_cell_table(spark, monkeypatch, many):
    monkeypatch.setattr(P, "MANY", many)
    tables = {"t": table(spark), "u": spark.createDataFrame([(5,), (None,), (40_000,), (5,), (70_001,)], "k int"), "none": spark.createDataFrame([], "k int, s string")}
    monkeypatch.setattr(P, "DENSE", 1 if many == 1 else P.DENSE)
    if many == 1:
        assert {(f.dataset, f.column_name) for f in P.measure(tables) if f.route == "bitmap"} == {("t", "id"), ("u", "k")}
    got = {(r.dataset, r.column_name): r for r in P.profile_tables(tables).collect()}
    want = {(r.dataset, r.column_name): r for r in P.profile_columns(S.all_cells(tables)).collect()}
    assert want.keys() == got.keys()
    for k in want:
        assert got[k].asDict() == want[k].asDict(), k


def test_values_as_text(spark):
    df = table(spark)
    got = sorted(map(tuple, P.profile_and_values({"t": df})[1].collect()), key=repr)
    want = S.cells(df, "t").groupBy("dataset", "column_name", "ordinal", "native_type", "value").agg(F.count("*").alias("n"))
    assert got == sorted(map(tuple, want.collect()), key=repr)


def test_numbers_that_are_none(spark):
    df = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (1e300,), (None,)], "x double")
    got, want = P.profile_tables({"t": df}).first(), P.profile_columns(S.cells(df, "t")).first()
    assert got.asDict() == want.asDict() and got.distinct_count == 5


def keys(spark):
    part = lambda lo, hi, name: spark.range(lo, hi).select(F.col("id").alias("key"), F.concat(F.lit(name), F.col("id")).alias("name"))
    big = spark.range(60_000).select((F.col("id") % 5000).alias("key"), F.lit("same").alias("note"))
    return {"a": part(0, 5000, "n"), "b": part(100_000, 105_000, "n"), "c": big, "d": part(0, 900, "x"), "e": part(600, 1500, "x")}


def test_sketches_leave_pairs_out_and_lose_nothing(spark):
    tables = keys(spark)
    profile = P.profile_tables(tables).withColumn("is_technical", F.lit(False))
    whole = {(r.a_dataset, r.a_column_name, r.b_dataset): r for r in G.column_overlap(tables, profile).collect()}
    some = {(r.a_dataset, r.a_column_name, r.b_dataset): r for r in G.column_overlap(tables, profile, 0.6, 0.9).collect()}
    assert whole.keys() == some.keys() and all(r.joined for r in whole.values())
    left = {k for k, r in some.items() if not r.joined}
    assert ("a", "key", "b") in left and ("d", "key", "e") in left and ("d", "name", "e") in left and ("a", "key", "c") not in left
    print("joined", len(some) - len(left), "of", len(some))
    for k, r in some.items():
        if r.joined:
            assert (r.shared, r.overlap) == (whole[k].shared, whole[k].overlap)
        else:
            assert r.shared is None and whole[k].overlap < 0.6
    edges = lambda o: sorted(map(tuple, G.discover_foreign_keys(o).collect()))
    found = edges(G.column_overlap(tables, profile, 0.6, 0.9))
    assert found == edges(G.column_overlap(tables, profile)) and ("c", "a", "key", 5000, 0.98) in found
    assert G.column_overlap({"a": tables["a"]}, profile.filter("dataset = 'a'"), 0.6).collect() == []
