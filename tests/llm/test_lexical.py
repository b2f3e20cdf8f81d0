"""Ranks against plain Python, and the SQL of the query."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from trustloom.llm import lexical
from trustloom.llm.queries import QUERIES, SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain(docs, items, k):
    own = [(d, Counter(TERM.findall((t or "").translate(SMALL)))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, length = len(own), sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in items:
        scores = []
        words = set(TERM.findall((text or "").translate(SMALL)))
        held = {w: sum(w in c for _, c in own) for w in words}
        for d, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            scores += [(-score, d is not None, d or 0, d)] if score > 0 else []
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(n, seed=3):
    draw = random.Random(seed)
    words = [f"W{int(draw.paretovariate(0.7))}" for _ in range(4000)] + ["ä", "Ünd", "x_y", "a b", " z"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,- "), (None, docs[3][1]), (3, docs[3][1]), (n + 3, "W1 w2 " * 50_000)] + [(n + 4 + i, docs[5][1]) for i in range(n)]
    return docs, [(i, " ".join(draw.choices(words, k=12))) for i in range(30)] + [(3, docs[5][1]), (50, None), (51, "..."), (52, "none-such-term"), (None, "W1")]


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranks(spark, k):
    docs, items = corpus(300)
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, rank int, item string").repartition(6)
    got = lexical.search(d, spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, score int"), k=k)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, k)


def test_items_in_parts_and_no_rows(spark, monkeypatch):
    docs, items = corpus(120)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(lexical, "ITEMS", 9)
    assert sorted(map(tuple, lexical.search(d, i, k=5).collect()), key=repr) == plain(docs, items, 5)
    assert lexical.search(d.limit(0), i).collect() == [] and lexical.search(d, i.limit(0)).collect() == []


def test_bounds_leave_pairs_out_and_lose_nothing(monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 4)
    rng = np.random.default_rng(1)
    weights = rng.integers(1, 9000, 200)
    items = [np.sort(rng.choice(np.arange(10 * g, 10 * g + 10), 6, replace=False)) for g in range(20)]
    docs = [np.sort(rng.choice(np.arange(10 * g, 10 * g + 10), 5, replace=False)) for g in range(20) for _ in range(16)]
    values = [rng.integers(1, 10**6, 5) for _ in docs]
    best = lexical.Best(len(items), 3, np.zeros(len(items)))
    ends = np.append(0, np.cumsum([len(d) for d in docs]))
    scored, there = lexical.dual(lexical.ItemTree(items, weights), best, np.arange(len(docs)), np.concatenate(docs), np.concatenate(values), ends, 200)
    assert scored < 0.5 * there
    for i, item in enumerate(items):
        best.settle(i)
        scores = sorted(((-sum(int(weights[t]) * int(v) for t, v in zip(d, vs) if t in item), at) for at, (d, vs) in enumerate(zip(docs, values))))[:3]
        assert [(-s, at) for s, at in scores] == list(zip(best.scores[i].tolist(), best.ids[i].tolist()))


def test_query_and_sql(spark, tmp_path):
    docs, items = corpus(200)
    docs, items = [d for d in docs if d[0] != 3], [i for i in items if i[0] not in (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = sorted(con.execute(SQL["op11_lexical"]).fetchall(), key=repr)
    assert sorted(map(tuple, QUERIES["op11_lexical"](spark, str(tmp_path)).collect()), key=repr) == theirs == plain(docs, items, 50)
