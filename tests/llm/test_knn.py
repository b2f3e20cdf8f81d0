"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.llm import projected_knn as K

SCHEMA = "vec_id long, embedding array<float>, v string"


def brute(rows, k):
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)]
    return {i: sorted((-float(v @ w), j) for j, w in good if j != i)[:k] for i, v in good if i % 20 == 0}


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * (3 if kind == "clustered" else 0)
    rows = [(i, (centres[i % 12] + rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[40][1]) for i in range(60)]  # a common vector: ties go to the smaller id
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] + [1.0] * 15), (3080, [float("inf")] * 16), (None, rows[0][1]), (3100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = {}
    for r in K.largest_products(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([r for r in rows if r[0] != 3100], 20)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))
        assert [(-s, v) for _, v, s in sorted(found)] == sorted((-s, v) for _, v, s in found)
    copies = [v for _, v, _ in sorted(got[40]) if v >= 2000]
    assert copies == list(range(2000, 2000 + len(copies)))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [3.0, 1.0], ""), (20, [0.5, 0.5], "")], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in K.largest_products(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 5.0), (0, 2, 20, 1.5), (20, 1, 1, 2.0), (20, 2, 0, 1.5)]
    assert K.largest_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert K.largest_products(df, F.lit(False)).count() == 0


def test_chi_square():
    assert abs(K.chi_square(K.chi_square_quantile(0.98, 6), 6) - 0.98) < 1e-9
    assert abs(K.chi_square_quantile(0.95, 6) - 12.5916) < 1e-3


def test_kd_tree():
    points = np.random.default_rng(2).standard_normal((500, 3))
    order, nodes, boxes = K.kd_tree(points, 20)
    assert sorted(order.tolist()) == list(range(500))
    leaves = sorted((a, b) for a, b, left, _ in nodes.tolist() if left < 0)
    assert leaves[0][0] == 0 and leaves[-1][1] == 500 and all(0 < b - a <= 20 for a, b in leaves)
    assert all(x[1] == y[0] for x, y in zip(leaves, leaves[1:]))
    for (a, b, _, _), box in zip(nodes.tolist(), boxes):
        assert (points[order[a:b]] >= box[0]).all() and (points[order[a:b]] <= box[1]).all()


def test_cells():
    points = np.random.default_rng(3).standard_normal((400, 3))
    points[:150] = points[0]
    cells = K.Cells(points, 16)
    at = cells.of(points)
    assert 4 <= len(cells.boxes) <= 16 and len({*at[:150].tolist()}) == 1
    for p, c in zip(points, at.tolist()):
        assert (p >= cells.boxes[c][0]).all() and (p <= cells.boxes[c][1]).all()


def test_repeated_rows(spark):
    """21 rows (1, v) and 27 rows equal in vector: each row is a candidate of its own."""
    v, w = [0.17, 0.2, -0.3], [0.1, 0.3, 0.1]
    rows = [(20, v)] + [(1, v)] * 21 + [(100 + i, v) for i in range(27)]
    got = sorted((r["rank"], r.vec_id) for r in K.largest_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect())
    assert got == [(i + 1, 1) for i in range(20)]
    rows = [(20, v), (1, v), (1, v), (1, v), (2, w), (20, w)]
    got = sorted((r["rank"], r.vec_id, r.score) for r in K.largest_products(spark.createDataFrame(rows[:-1], "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect())
    assert [(r, i) for r, i, _ in got] == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert got[0][2] == sum(x * x for x in v)
    got = K.largest_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == sorted([(1, 1), (2, 1), (3, 1), (4, 2)] + [(1, 2), (2, 1), (3, 1), (4, 1)])


@pytest.mark.parametrize("n", [1000, 4000])
def test_recall_over_many_cells(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in K.largest_products(df, F.col("vec_id") % 20 == 0, block_rows=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 20):
        score = x @ x[q]
        score[q] = -9
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.95 * 20 * len(got)
