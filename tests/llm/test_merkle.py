"""The manifest against plain Python, and its SQL."""

import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from trustloom.llm import merkle
from trustloom.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node long, at int, _seq int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    for row in tree[:-1]:
        near = at ^ 1
        yield (row[near] if near < len(row) else None), at & 1
        at //= 2


def plain(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    order = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), first(r[0]), leaf(r[0], r[3], r[2], r[4], r[1])))
    groups = [list(g) for _, g in groupby(order, key=lambda r: r[2])]
    trees = [levels([leaf(r[0], r[3], r[2], r[4], r[1]) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for own, (group, tree) in enumerate(zip(groups, trees)):
        for at, r in enumerate(group):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r[0], r[3], r[2], r[4] + 1 if r[4] is not None and hit else r[4], r[1])
            proof = [*siblings(tree, at), *siblings(top, own)]
            for near, right in proof:
                folded = sha((near or "") + folded if right else folded + (near or ""))
            out.append((r[0], tree[0][at], tree[-1][0], top[-1][0], sha("".join(near or "" for near, _ in proof)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def docs(n):
    langs = ["en", None, "de", "ß", "", "zz"]
    rows = [(i, f"text {i}" * (i % 4), langs[0] if i % 3 else langs[i % 6], "s", i, "x", i, 0, 0) for i in range(n)]
    return rows + [(None, None, None, None, None, "x", 1, 0, 0), (3, "ä" * 100_000, "en", None, None, "x", 1, 0, 0), (5, "one", "single", "s", 2, "x", 1, 0, 0)] + [(7, "same", "en", "s", 4, "x", 1, 0, 0)] * 9


@pytest.mark.parametrize("n", [1, 300])
def test_manifest(spark, tmp_path, n):
    rows = docs(n)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_merkle"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(SQL["op13_merkle"]).fetchall(), key=repr) == plain(rows)


def test_without_rows_and_by_exchange(spark, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none).collect() == []
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 0)
    rows = docs(150)
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fields=("doc_id", "source", "lang", "n_chars", "text"))
    assert got.filter("not verified").count() == 0 and got.count() == len(rows)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
    assert got.select(F.max(F.length("proof") % 64)).first()[0] == 0
