"""Ranked lexical search: the k best documents of each item, by exact integer scores, with one tree over items and one over documents.

1. Documents are read once: the terms that items hold, their counts and the document's length become a row; texts don't move. Counts of documents and terms are Spark aggregates over all rows.
2. A document's vector holds for each of its terms what the term adds per unit of weight. Vectors are dealt by their heaviest term (salted, so that a term of any
   frequency spreads) and sorted by it, so that neighbours share heavy terms. A tree stands over the vectors of a batch, another over the items; a node holds the
   largest value of each coordinate below it.
3. The product of two nodes' maxima bounds every score between them. From the two roots down, level by level, a pair is left out with all below it if its bound is under the
   weakest k-th score of the node's items; where an item and a leaf of documents meet, scores are computed exactly. Tasks begin with the k-th scores of one part in SEED of the
   documents, found in the same way: these can only be too low, so nothing is lost.
4. Each task's best go to one window per item.

Items are taken in parts of about ITEMS, and each part makes one pass over the documents: the driver and the tasks hold the terms of one part.

Nulls: a null text has no term, and an item or document without terms has no place in any ranking; a null document id sorts first among equal scores. Repeated rows are documents of their own, and
rows that repeat an item are ranked each by itself. Very long texts are one row of counts. Other columns aren't read. No rows: no ranks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import memory, scratch

#: Items of one pass, about; documents of a batch and of a leaf. A leaf of the items' tree is one item.
ITEMS, BATCH, LEAF = 512, 1024, 4
#: Bounds are computed in single precision and raised by more than its rounding of a few thousand products.
RAISED = np.float32(1.001)
SEED, SALT = 16, 64
_NONE = -(1 << 63)
#: Digits, letters and all bytes beyond ASCII stay, A-Z become small, all else parts terms.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def postings(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, n, terms, counts of every document that has a term; terms are places in words."""
    memory.small_batches(docs.sparkSession)
    place = {w: i for i, w in enumerate(words)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, ends, found, counts = [], [], [0], [], []
            for at, text in zip(batch.column(0), batch.column(1)):
                own = terms(text.as_py())
                if not own:
                    continue
                tally = Counter(own)
                mine = sorted((place[w], tally[w]) for w in tally.keys() & place.keys())
                found += [t for t, _ in mine]
                counts += [c for _, c in mine]
                ids.append(at.as_py())
                lengths.append(len(own))
                ends.append(len(found))
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), lists(found, pa.int32()), lists(counts, pa.int64())], ["id", "n", "terms", "counts"])
            memory.release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(read, "id long, n long, terms array<int>, counts array<long>")


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's end."""
    col = batch.column(batch.schema.get_field_index(name))
    ends = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]


def vectors(found: DataFrame, weights: np.ndarray, docs: int, length: int) -> DataFrame:
    """id, lead (the heaviest term), terms, values of every document with a term of an item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends = _flat(batch, "terms")
            tf, _ = _flat(batch, "counts")
            m = np.array([50 + 50 * n * docs // length for n in batch.column(1).to_pylist()], np.int64)
            sizes = np.diff(ends)
            value = 10**9 * tf // (1000 * tf + 20 * np.repeat(m, sizes))
            heavy = weights[own] * value
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((own, -heavy, row))
            lead = own[order[ends[:-1]]] if len(own) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lead, pa.int32()), batch.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value, pa.int64()))], ["id", "lead", "terms", "values"])

    return found.filter(F.size("terms") > 0).mapInArrow(read, "id long, lead int, terms array<int>, values array<long>")


class ItemTree:
    """Levels of nodes over the items, leaves first; a node covers two of the level below, and holds the largest weight of each term. Items that share heavy terms are neighbours."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        by_weight = [sorted(t.tolist(), key=lambda x: (-weights[x], x)) for t in items]
        self.order = np.array(sorted(range(len(items)), key=lambda i: by_weight[i]))
        self.terms = [items[i] for i in self.order]
        self.weights = [weights[t].astype(float) for t in self.terms]
        leaves = np.zeros((len(items), len(weights)), np.float32)
        for row, own in enumerate(self.terms):
            leaves[row, own] = weights[own]
        self.levels = halved(leaves)

    def least(self, of_items: np.ndarray) -> list[np.ndarray]:
        """For each level the weakest score that a node's items ask for."""
        out = [np.maximum(of_items[self.order], 1.0)]
        while len(out[-1]) > 1:
            out.append(np.minimum.reduceat(out[-1], np.arange(0, len(out[-1]), 2)))
        return out


def halved(rows: np.ndarray) -> list[np.ndarray]:
    """rows, and above them the maxima of two and two, up to one."""
    out = [rows]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), 2), axis=0))
    return out


class Best:
    """The k best (score, id) of each item so far, and the score that the next must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.least = k, floor.astype(float)
        self.scores, self.ids = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.more: list[list[tuple]] = [[] for _ in range(n)]
        self.waiting = [0] * n

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.more[item].append((scores, ids))
        self.waiting[item] += len(ids)
        if self.waiting[item] >= self.k:
            self.settle(item)

    def settle(self, item: int) -> None:
        scores = np.concatenate([self.scores[item], *[s for s, _ in self.more[item]]])
        ids = np.concatenate([self.ids[item], *[i for _, i in self.more[item]]])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item], self.more[item], self.waiting[item] = scores[top], ids[top], [], 0
        if len(top) == self.k:
            self.least[item] = max(self.least[item], float(self.scores[item][-1]))


def dual(tree: ItemTree, best: Best, ids: np.ndarray, own: np.ndarray, values: np.ndarray, ends: np.ndarray, width: int) -> tuple[int, int]:
    """Walk both trees over one batch of documents, level by level; (pairs of an item and a leaf that are scored, pairs there are)."""
    leaves = -(-len(ids) // LEAF)
    dense = np.zeros((leaves * LEAF, width), np.float32)  # values are at most a million: exact
    dense[np.repeat(np.arange(len(ids)), np.diff(ends)), own] = values
    tops, least = halved(dense.reshape(leaves, LEAF, width).max(axis=1)), tree.least(best.least)
    a, b, alive = len(tree.levels) - 1, len(tops) - 1, np.ones((1, 1), bool)
    while True:
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return 0, leaves * len(tree.order)
        bound = (tree.levels[a][rows] @ tops[b][cols].T) * RAISED
        alive[np.ix_(rows, cols)] &= bound >= least[a][rows][:, None]
        if a == b == 0:
            break
        if b and (not a or LEAF << b >= 1 << a):  # the larger side is opened
            b -= 1
            alive = np.repeat(alive, 2, axis=1)[:, : len(tops[b])]
        else:
            a -= 1
            alive = np.repeat(alive, 2, axis=0)[: len(tree.levels[a])]
    for row in np.flatnonzero(alive.any(axis=1)).tolist():
        docs = (np.flatnonzero(alive[row])[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(ids)]
        scores = dense[np.ix_(docs, tree.terms[row])].astype(float) @ tree.weights[row]  # whole numbers far below 2**53: exact
        item = int(tree.order[row])
        hit = (scores >= best.least[item]) & (scores > 0)
        if hit.any():
            best.add(item, scores[hit].astype(np.int64), ids[docs[hit]])
    return int(alive.sum()), leaves * len(tree.order)


def best_of(dealt: DataFrame, tree: ItemTree, n_items: int, width: int, k: int, floor: np.ndarray, walked=None) -> DataFrame:
    """item, id, score: of each partition the k best documents of each item that reach the floor."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, rows = Best(n_items, k, floor), [], 0

        def walk():
            nonlocal held, rows
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                for batch in table.to_batches(max_chunksize=BATCH):
                    own, ends = _flat(batch, "terms")
                    values, _ = _flat(batch, "values")
                    done = dual(tree, best, batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False), own, values, ends, width)
                    if walked is not None:
                        walked.add(complex(*done))
                held, rows = [], 0
                memory.release()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                walk()
        walk()
        for item in range(n_items):
            best.settle(item)
        items = np.repeat(np.arange(n_items), [len(x) for x in best.ids])
        ids = np.concatenate([*best.ids, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(ids, pa.int64(), mask=ids == _NONE), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]), pa.int64())], ["item", "id", "score"])

    return dealt.select("id", "terms", "values").mapInArrow(read, "item int, id long, score long")


def _part(docs: DataFrame, items: list, id_col: str, text_col: str, k: int, walked=None) -> DataFrame | None:
    """item (its place in items), id, score, rank of one part of the items."""
    spark = docs.sparkSession
    words = sorted({w for _, ws in items for w in ws})
    if not words:
        return None
    found = scratch.stored(postings(docs, words, id_col, text_col), "postings")
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        return None
    holding = {r.term: r.n for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per word of a part
    weights = np.array([weight(total.docs, holding.get(i, 0)) for i in range(len(words))], np.int64)
    place = {w: i for i, w in enumerate(words)}
    tree = ItemTree([np.array(sorted(place[w] for w in ws), np.int64) for _, ws in items], weights)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALT))
    dealt = vectors(found, weights, total.docs, total.terms).repartition(parts, "lead", salt).sortWithinPartitions("lead", "id")
    dealt = scratch.stored(dealt, "vectors")
    floor = np.zeros(len(items))
    first = best_of(dealt.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SEED)) == 0), tree, len(items), len(words), k, floor)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    for r in first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("item", "score").collect():  # one number per item of a part
        floor[r["item"]] = r["score"]
    all_ = best_of(dealt, tree, len(items), len(words), k, floor, walked)
    return all_.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 50, walked=None) -> DataFrame:
    """item_col, rank, id_col, score: the k best documents of each item with a score above 0, the smaller id first among equals.

    walked: an accumulator of complex numbers that receives (pairs of leaves scored, pairs of leaves there are).
    """
    spark = docs.sparkSession
    asked = scratch.stored(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "items")
    parts = -(-asked.count() // ITEMS)
    kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    for part in range(parts):
        own = sorted(asked.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).collect(), key=lambda r: r.row)  # about ITEMS rows
        some = [(r.item_id, ws) for r in own if (ws := set(terms(r.text)))]
        ranked = _part(docs, some, id_col, text_col, k, walked) if some else None
        if ranked is not None:
            names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(some)], f"item int, {item_col} {kind}")
            out = out.union(ranked.join(F.broadcast(names), "item").select(item_col, "rank", F.col("id").alias(id_col), "score"))
    return out


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with t as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
d as (select doc_id, r, cast(len(ws) as bigint) as n, ws from t where len(ws) > 0),
s as (select count(*) as docs, cast(sum(n) as bigint) as length from d),
i as (select item_id, row_number() over () as q, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ws from benchmark),
iw as (select item_id, q, unnest(ws) as w from i),
p as (select doc_id, r, n, w, count(*) as tf from (select doc_id, r, n, unnest(ws) as w from d) where w in (select w from iw) group by all),
wt as (select w, cast(floor(1000 * ln((2 * s.docs + 2) / (2 * count(*) + 1))) as bigint) as weight from p, s group by w, s.docs),
pv as (select p.doc_id, p.r, p.w, (1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * s.docs) // s.length)) as v from p, s),
sc as (select iw.item_id, iw.q, pv.doc_id, pv.r, cast(sum(wt.weight * pv.v) as bigint) as score from iw join pv on pv.w = iw.w join wt on wt.w = iw.w group by all)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls first) as rank from sc where score > 0) where rank <= 50
"""
