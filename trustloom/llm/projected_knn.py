"""Largest inner products by low-dimensional stable projections, kd-trees, and a chi-square stopping test.

A vector x becomes (x, sqrt(M - |x|^2)) with M the largest squared norm, a query q becomes (q, 0): the nearest in
Euclidean distance is then the largest in inner product. A Gaussian (2-stable) projection to m dimensions turns a squared
distance r into r times a chi-square variable with m degrees of freedom. The projected space is cut into cells by the upper levels of a kd-tree
(fitted on SAMPLE projected vectors at most, as the largest hashes choose them; every vector is indexed); a cell's vectors, in parts of bounded size, have a
kd-tree each. A query first walks the tree of a part of its own cell, nearer side first, and verifies with exact inner products what it
meets; then it goes, with the k-th product found so far, to the cells and through the trees that the test leaves: a box so far out
that a vector within the k-th distance found would be projected that far with a probability under `miss` is left out.

Equal vectors share one entry with their k + 1 smallest ids and how often each of these occurs (k times at most): all that can be asked for. A repeated row
is a candidate of its own. Rows with the query's own id are never its answer; rows of one query id with different vectors are queries of their own, equal rows
one query. Vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part; nor do vectors of another length
than most have. Fewer candidates than k: all of them. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
LEAF = 128
#: Cells of the projected space, at most, and projected vectors that choose their borders.
CELLS, SAMPLE = 4096, 1 << 16
_BATCH = 512
PLACED = "v array<double>, ids array<long>, times array<int>, cell int"
INDEX = "cell int, part int, n int, vectors binary, ids array<array<long>>, times array<array<int>>, nodes binary, boxes binary"
TOP = "array<struct<worse:double,vec_id:long>>"


def chi_square(x: float, m: int) -> float:
    """The chi-square distribution function with an even number m of degrees of freedom."""
    h = x / 2
    return 1 - math.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def chi_square_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def _projection(dim: int, m: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((dim + 1, m))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def kd_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points, nodes (first, one past the last, left and right child or -1) and their boxes; halves along the widest dimension."""
    order, nodes, boxes = np.arange(len(points)), [], []

    def grow(a: int, b: int) -> int:
        own = points[order[a:b]]
        at, box = len(nodes), np.stack([own.min(axis=0), own.max(axis=0)])
        nodes.append((a, b, -1, -1))
        boxes.append(box)
        if b - a > leaf:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(box[1] - box[0])], mid)]
            nodes[at] = (a, b, grow(a, a + mid), grow(a + mid, b))
        return at

    grow(0, len(points))
    return order, np.asarray(nodes, np.int64), np.stack(boxes)


class Cells:
    """A division of the projected space into boxes by the upper levels of a kd-tree."""

    def __init__(self, points: np.ndarray, n: int):
        m = points.shape[1]
        self.boxes: list[np.ndarray] = []
        self.tree = self._cut(points, n, np.stack([np.full(m, -np.inf), np.full(m, np.inf)]))

    def _cut(self, points: np.ndarray, n: int, box: np.ndarray):
        spread = points.max(axis=0) - points.min(axis=0) if len(points) > 1 else np.zeros(1)
        if n < 2 or not spread.max() > 0:
            self.boxes.append(box)
            return len(self.boxes) - 1
        dim = int(np.argmax(spread))
        at = len(points) * (n // 2) // n
        value = np.partition(points[:, dim], at)[at]
        if not (points[:, dim] < value).any():
            value = points[:, dim][points[:, dim] > value].min()
        left, right = box.copy(), box.copy()
        left[1, dim] = right[0, dim] = value
        low = points[:, dim] < value
        return dim, value, self._cut(points[low], n // 2, left), self._cut(points[~low], n - n // 2, right)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def go(node, own: np.ndarray) -> None:
            if isinstance(node, int):
                out[own] = node
            elif len(own):
                dim, value, left, right = node
                low = points[own, dim] < value
                go(left, own[low])
                go(right, own[~low])

        go(self.tree, np.arange(len(points)))
        return out


def _away(p: np.ndarray, box: np.ndarray) -> np.ndarray:
    return (np.maximum(0, np.maximum(box[0] - p, p - box[1])) ** 2).sum(axis=1)


def _build(project: np.ndarray, most: float):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"])
        order, nodes, boxes = kd_tree(_lifted(x, most) @ project)
        ids, times = ([pdf[c].iloc[i] for i in order] for c in ("ids", "times"))
        row = (pdf["cell"].iloc[0], pdf["part"].iloc[0], len(x), x[order].tobytes(), ids, times, nodes.tobytes(), boxes.tobytes())
        return pd.DataFrame([row], columns=[c.split()[0] for c in INDEX.split(", ")])

    return build


def _search(names: np.ndarray, q: np.ndarray, bound: np.ndarray, row, k: int, project: np.ndarray, most: float, reach: float) -> list[list[dict]]:
    """For each query the best rows of one part: at most k, and none that can't be among the best k."""
    x = np.frombuffer(row.vectors).reshape(row.n, -1)
    nodes = np.frombuffer(row.nodes, np.int64).reshape(-1, 4).tolist()
    boxes = np.frombuffer(row.boxes).reshape(len(nodes), 2, -1)
    p = np.hstack([q, np.zeros((len(q), 1))]) @ project
    norm = (q * q).sum(axis=1)
    want = min(k + 1, row.n)  # one may be the query itself
    best = np.full((len(q), want), -np.inf)  # the first column holds the least
    scores = np.full((len(q), row.n), -np.inf)

    def walk(node: int, own: np.ndarray) -> None:
        far = np.maximum(0, most + norm[own] - 2 * np.maximum(best[own, 0], bound[own]))
        own = own[~(_away(p[own], boxes[node]) > far * reach)]
        if not len(own):
            return
        a, b, left, right = nodes[node]
        if left < 0:
            got = q[own] @ x[a:b].T
            scores[own, a:b] = got
            both = np.hstack([best[own], got])
            best[own] = np.partition(both, both.shape[1] - want, axis=1)[:, -want:]
            best[own, 0] = best[own].min(axis=1)
            return
        near = _away(p[own], boxes[left]) <= _away(p[own], boxes[right])
        for child, part in ((left, near), (right, ~near), (right, near), (left, ~near)):
            walk(child, own[part])

    walk(0, np.arange(len(q)))
    slack = 1e-9 * (1 + most + norm)
    least = np.maximum(best[:, 0], bound) - slack
    out = []
    for i, (name, own) in enumerate(zip(names.tolist(), scores, strict=True)):
        at = np.flatnonzero((own >= least[i]) & (own > -np.inf))
        exact = (x[at] * q[i]).sum(axis=1)
        pairs = []
        for s, j in zip(exact.tolist(), at.tolist(), strict=True):
            for v, times in zip(row.ids[j], row.times[j], strict=True):
                if v != name:
                    pairs += [(-s, int(v))] * int(times)
        out.append([{"worse": s, "vec_id": v} for s, v in sorted(pairs)[:k]])
    return out


def largest_products(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, m: int = 6, miss: float = 0.02, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where the column is_query holds, against all rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    sized = rows.withColumn("dim", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    dims = sized.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("most")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, most = dims[0].dim, dims[0].n, dims[0].most
    rows = sized.filter(F.col("dim") == dim).select("vec_id", "v", "asks")
    project, reach = _projection(dim, m), chi_square_quantile(1 - miss, m)

    some = rows.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < max(1, min(1 << 20, SAMPLE * (1 << 20) // n))).select("v").distinct()
    some = [r.v for r in some.orderBy(F.xxhash64("v")).limit(SAMPLE).collect()] or [rows.first().v]
    cells = Cells(_lifted(np.asarray(some), most) @ project, min(CELLS, -(-n // block_rows)))

    # equal vectors: one entry with the smallest ids, each with its number
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("at") <= k + 1)
    one = ranked.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("x")).select("v", F.col("x.vec_id").alias("ids"), F.col("x.times").alias("times"))

    def place(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(cell=cells.of(_lifted(np.stack(pdf["v"]), most) @ project))

    placed = scratch.stored(one.mapInPandas(place, PLACED), "placed")
    # a row per cell, CELLS at most
    parts = scratch.stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")), "parts")
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int"))
    index = scratch.stored(dealt.select("cell", "part", "v", "ids", "times").groupBy("cell", "part").applyInPandas(_build(project, most), INDEX), "kd")

    def home(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(cell=cells.of(np.hstack([np.stack(pdf["v"]), np.zeros((len(pdf), 1))]) @ project))

    asked = rows.filter("asks").select("vec_id", "v").distinct().select(F.col("vec_id").alias("query_id"), "v")
    asked = asked.mapInPandas(home, "query_id long, v array<double>, cell int").join(F.broadcast(parts), "cell", "left")
    asked = asked.withColumn("part", F.coalesce(F.pmod(F.xxhash64("query_id", "v"), "parts").cast("int"), F.lit(-1)))
    asked = scratch.stored(asked.select("query_id", "v", "cell", "part", F.lit(float("-inf")).alias("bound")), "asked")

    def search(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                names, q, bound = np.asarray([x["query_id"] for x in row.qs], np.int64), np.stack([x["v"] for x in row.qs]), np.asarray([x["bound"] for x in row.qs])
                for a in range(0, len(names), _BATCH):
                    own = slice(a, a + _BATCH)
                    yield pd.DataFrame({"query_id": names[own], "v": list(q[own]), "part": (row.cell * 31 + row.part) % 64, "top": _search(names[own], q[own], bound[own], row, k, project, most, reach)})

    def searched(routed: DataFrame) -> DataFrame:
        """What the queries find in the parts they are sent to, in groups of bounded size."""
        size = routed.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("chunks"))
        chunked = routed.join(size, ["cell", "part"]).withColumn("chunk", F.pmod(F.xxhash64("query_id", "v"), "chunks"))
        tasks = chunked.groupBy("cell", "part", "chunk").agg(F.collect_list(F.struct("query_id", "v", "bound")).alias("qs")).join(index, ["cell", "part"])
        n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        return tasks.repartition(n_tasks, "cell", "part", "chunk").mapInPandas(search, f"query_id long, v array<double>, part int, top {TOP}")

    first = scratch.stored(searched(asked.filter("part >= 0")), "first")
    known = asked.drop("bound").join(first.drop("part"), ["query_id", "v"], "left")
    known = known.withColumn("bound", F.when(F.size("top") >= k, -F.col("top")[k - 1]["worse"]).otherwise(F.lit(float("-inf")))).drop("top")
    boxes = np.stack(cells.boxes)

    def route(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            q = np.stack(pdf["v"])
            p = np.hstack([q, np.zeros((len(q), 1))]) @ project
            far = np.maximum(0, most + (q * q).sum(axis=1) - 2 * pdf["bound"].to_numpy()) * reach
            for cell, box in enumerate(boxes):
                near = ~(_away(p, box) > far)
                if near.any():
                    yield pdf[near].assign(to=cell)

    routed = known.mapInPandas(route, "query_id long, v array<double>, cell int, part int, bound double, to int")
    routed = routed.withColumnsRenamed({"cell": "own_cell", "part": "own_part", "to": "cell"}).join(F.broadcast(parts), "cell")
    routed = routed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("cell <> own_cell or part <> own_part")
    routed = scratch.stored(routed.select("query_id", "v", "cell", "part", "bound"), "routed")

    best = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k)
    found = first.unionByName(searched(routed)).filter(F.size("top") > 0)
    some = found.groupBy("query_id", "v", "part").agg(best("top").alias("top"))  # a query gets k rows at most from each of 64 groups
    top = some.groupBy("query_id", "v").agg(best("top").alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.worse")).alias("score"))


def op10_projected_knn(spark, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 20: its 20 largest inner products with all the other vectors."""
    return largest_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
