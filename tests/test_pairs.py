"""Pairs of values are counted, not whole rows; their entities are made once per pair."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from trustloom.functions import text
from trustloom.operators import graph as G


def test_pairs_are_counted_not_rows(spark):
    draw = random.Random(5)
    rows = [tuple(draw.choice([" A", "a", "b", None]) for _ in range(4)) for _ in range(400)]
    cols = {"w": "vendor", "x": "application", "y": "cost_center", "z": "vendor"}
    wide = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    pairs = G.pair_counts(wide, list(cols))
    want = Counter((k, r[i], r[j]) for r in rows for k, (i, j) in enumerate(combinations(range(4), 2)))
    assert {(r.pair, r.u, r.v): r.n for r in pairs.collect()} == want
    name = lambda role, v: F.concat(F.lit(role + ":"), text.normalised(v))
    late = G.cooccurrence_edges(wide, cols, entity=name)
    early = G.cooccurrence_edges(wide.select(*[name(r, F.col(c)).alias(c) for c, r in cols.items()]), cols)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect())) and late.count() > 5
