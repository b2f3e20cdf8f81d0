"""Near pairs, links and widths against brute force, and how many tile pairs the pivots leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustloom.operators import resolve as R
from trustloom.operators import vectors as V


def clusters(n, each, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n, dim))
    return np.concatenate([c + 0.08 * rng.standard_normal((each, dim)) for c in centres])


def frame(spark, x, **more):
    rows = [(i, *[f(i) for f in more.values()], v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"{k} int" for k in more], "v array<double>"]))


def distances(x):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm > 0, norm, 1)
    return 1 - u @ u.T


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(V, "TILE", 32)


def test_pivots_leave_out_most_tile_pairs_of_clusters(spark, small_tiles):
    df = frame(spark, clusters(20, 64), role=lambda i: 0)
    compared, there = V.skipped_share(df, "role", 0.05)
    print("compared", compared, "of", there)
    assert there > 700 and compared < 0.25 * there


@pytest.mark.parametrize("limit", [10, None])
def test_similar_pairs(spark, small_tiles, limit):
    x = np.concatenate([clusters(6, 40), np.zeros((3, 24)), np.ones((5, 24))])
    got = [tuple(r) for r in V.similar_pairs(frame(spark, x, grp=lambda i: i % 3), 0.04, limit).collect()]
    d = distances(x)
    want = sorted((d[a, b], a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if a % 3 != b % 3 and d[a, b] < 0.04)
    want = want[:limit]
    assert len(got) == len(want) > 5
    assert np.allclose([g[2] for g in got], [w[0] for w in want], atol=1e-9) if limit else {g[:2] for g in got} == {w[1:] for w in want}


@pytest.mark.parametrize("bound", [0.03, 0.5, 1.2])
def test_links_connect_what_is_near(spark, small_tiles, bound):
    x = np.concatenate([clusters(5, 30), np.zeros((4, 24))])
    role = lambda i: i % 2 if i % 7 else None
    links = V.match_within(frame(spark, x, role=role), "role", bound)
    got = {r.node: r.component for r in R.connected_components(links, spark.range(len(x))).collect()}
    d, root = distances(x), list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(x)):
        for b in range(a):
            if role(a) is not None and role(a) == role(b) and d[a, b] < bound:
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    assert got == {i: find(i) for i in range(len(x))}
    assert links.count() < 4 * len(x) * 5


def test_widths_of_chains_stars_and_copies(spark, small_tiles):
    turn = np.linspace(0, 2.0, 90)
    chain = np.stack([np.cos(turn), np.sin(turn), 0 * turn], axis=1)
    star = np.concatenate([[[0, 0, 1]], clusters(1, 80, 3) * 0.3 + [0, 0, 1]])
    groups = {0: chain, 1: star, 2: np.ones((70, 3)), 3: np.array([[1.0, 0, 0]]), 4: np.array([[1.0, 0, 0], [0, 0, 0]]), 5: np.array([[1.0, 0, 0], [-1, 0, 0], [0, 1, 0]]), 6: np.zeros((3, 3)), 7: np.random.default_rng(2).standard_normal((150, 3))}
    rows = [(g, f"{g}/{i}", v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "component int, node string, v array<double>")
    got = {r.component: (r.size, r.far) for r in V.widest(df.withColumnRenamed("node", "id"), "component").collect()}
    for g, x in groups.items():
        d = distances(x)
        np.fill_diagonal(d, 0)
        assert got[g][0] == len(x) and abs(got[g][1] - max(0, d.max())) < 1e-9, g
    sure = {r.component: r.confidence for r in R.cluster_confidence(df.select("node", "component"), df.select("node", "v")).collect()}
    assert all(abs(sure[g] - min(1, max(0, 1 - got[g][1]))) < 1e-12 for g in groups)
    assert V.widest(df.filter(F.lit(False)).withColumnRenamed("node", "id"), "component").collect() == []
