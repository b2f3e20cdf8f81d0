"""Value vectors and similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import scratch


def distinct_values(cells: DataFrame, limit: int | None = 500) -> DataFrame:
    """dataset, column_name, value: trimmed, non-empty, at most `limit` per column in order of value (None: all)."""
    some = cells.withColumn("value", text.trimmed(F.col("value"))).filter("value <> ''").groupBy("dataset", "column_name", "value").agg(F.count("*").alias("n"))
    if limit is None:
        return some
    w = Window.partitionBy("dataset", "column_name").orderBy("value")
    return some.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= limit).drop("_at")


def hash_embed(values: DataFrame, key: str, col: str, dim: int = 1536) -> DataFrame:
    """key, idx, w: the sparse unit vector of a text, from its characters and their places. One exchange, on (key, idx)."""
    t = text.normalised(F.col(col))
    chars = values.select(F.col(key).alias("key"), F.posexplode(F.split(t, "")).alias("i", "c")).filter("c <> ''")
    code = F.ascii("c")
    raw = chars.groupBy("key", ((code * (F.col("i") + 1)) % dim).alias("idx")).agg(F.sum(F.sin((code + F.col("i")).cast("double"))).alias("v"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, "key").select("key", "idx", (F.col("v") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))


def attach_vectors(values: DataFrame, given: DataFrame | None, key: str, text_col: str | None = None, dim: int = 1536) -> DataFrame:
    """Each value's own vector if one is supplied, else the hash vector of its text (the key itself by default); embedding_source tells which."""
    kind = "array<double>"
    both = values.withColumn("vector", F.lit(None).cast(kind)) if given is None else values.join(given.select(key, F.col("vector").cast(kind).alias("vector")), key, "left")
    bare = both.filter("vector is null").select(F.col(key).alias("_key"), F.col(text_col or key).cast("string").alias("_text")).dropDuplicates(["_key"])
    hashed = hash_embed(bare, "_key", "_text", dim).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("_w"))
    dense = F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_w", i), F.lit(0.0))))
    filled = both.join(hashed, both[key] == hashed["key"], "left").withColumn("embedding_source", F.when(F.col("vector").isNotNull(), "given").otherwise("hash"))
    return filled.withColumn("vector", dense).select(*values.columns, "vector", "embedding_source")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms).otherwise(1.0)


def sparse_distances(vectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """a, b, distance of sparse unit vectors that share an index (others are 1 apart), a < b."""
    b = vectors.select(F.col("key").alias("b"), "idx", F.col("w").alias("wb"))
    both = vectors.select(F.col("key").alias("a"), "idx", F.col("w").alias("wa")).join(b, "idx").filter("a < b")
    return both.groupBy("a", "b").agg((1 - F.sum(F.col("wa") * F.col("wb"))).alias("distance"))


def signatures(col: Column, dim: int, planes: int, tables: int, seed: int = 17) -> Column:
    """An array of `tables` random-hyperplane signatures of a dense vector: equal ones make a pair a candidate."""
    w = np.random.default_rng(seed).standard_normal((tables, planes, dim))
    bit = lambda p: F.when(dot(col, F.array(*[F.lit(float(x)) for x in p])) > 0, 1).otherwise(0)
    return F.array(*[sum(((bit(p)) * (1 << i) for i, p in enumerate(t)), F.lit(t_no << planes)) for t_no, t in enumerate(w)])


#: Rows and bytes of one tile; pivots, and the rows that they are chosen from.
TILE, TILE_BYTES, PIVOTS, SAMPLE = 2048, 1 << 20, 12, 2048
#: Angles are compared with so much to spare: more than rounding can move them.
SPARE = 1e-6


def _unit(lists) -> np.ndarray:
    """Unit vectors as rows; a null component counts as zero, and a zero vector stays zero."""
    x = np.nan_to_num(np.asarray([[0.0 if c is None else c for c in v] for v in lists], float))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def pivots(vectors: DataFrame, n: int = PIVOTS) -> np.ndarray:
    """Up to n unit vectors, each as far as can be from those before it, from SAMPLE rows (id, v) at most."""
    rows = vectors.select(F.xxhash64("id").alias("h"), "v").orderBy("h").limit(SAMPLE).collect()
    x = _unit([r["v"] for r in rows]) if rows else np.zeros((0, 1))
    x = x[(x * x).sum(axis=1) > 0.5]
    chosen: list[int] = []
    nearest = np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.arccos(np.clip(x @ x[chosen[-1]], -1, 1)))
        nearest[chosen] = -1
    return x[chosen]


def turned(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """vectors with turns (the angles to the points, of a zero vector none), cell (the nearest point, or -1) and turn (the angle to it)."""

    @F.pandas_udf("cell int, turns array<double>")
    def measure(v: pd.Series) -> pd.DataFrame:
        x = _unit(v)
        zero = (x * x).sum(axis=1) < 0.5
        turns = np.arccos(np.clip(x @ points.T, -1, 1)) if len(points) else np.zeros((len(x), 0))
        cell = np.where(zero | (turns.shape[1] == 0), -1, turns.argmin(axis=1) if turns.shape[1] else 0)
        return pd.DataFrame({"cell": cell.astype("int32"), "turns": list(turns)})

    out = vectors.withColumn("_m", measure("v")).select(*vectors.columns, "_m.cell", "_m.turns")
    return out.withColumn("turn", F.when(F.col("cell") >= 0, F.get("turns", F.col("cell"))).otherwise(0.0))


def tiles(rows: DataFrame, by: str) -> DataFrame:
    """by, tile, size, low, high, ids, groups, x: rows (by, id, grp, v, turns, cell, turn) in tiles of bounded size whose members turn alike from the pivots.

    One range exchange; a tile is a run of one group and cell, so a group of any size is many tiles. low and high are the least and the largest angle to each
    pivot; x is the matrix of unit vectors, row by row. Zero vectors are tiles of their own whose angles can be anything.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [by, "cell", "turn", F.xxhash64("id")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(by, "id", "grp", "v", "turns", "cell")
    kind = {c: rows.schema[c].dataType.simpleString() for c in (by, "id", "grp")}

    def cut(frames):
        from pyspark import TaskContext

        part, made, held, key, size = TaskContext.get().partitionId(), 0, [], None, 0

        def tile():
            nonlocal made, held, size
            if not held:
                return
            run, made, held, size = pd.concat(held), made + 1, [], 0
            x = _unit(run["v"])
            turns = np.stack(run["turns"].to_numpy()) if len(run["turns"].iloc[0]) else np.zeros((len(run), 0))
            free = run["cell"].iloc[0] < 0
            low, high = (np.zeros(turns.shape[1]), np.full(turns.shape[1], math.pi)) if free else (turns.min(axis=0), turns.max(axis=0))
            yield pd.DataFrame({by: [key[0]], "tile": [(part << 32) + made], "size": [len(run)], "low": [low], "high": [high], "ids": [run["id"].tolist()], "groups": [run["grp"].tolist()], "x": [x.ravel()]})

        for pdf in frames:
            for now, run in pdf.groupby([by, "cell"], sort=False, dropna=False):
                at, most = 0, max(16, min(TILE, TILE_BYTES // (8 * max(1, len(run["v"].iloc[0])))))
                if key is None or now != key:
                    yield from tile()
                    key = now
                while at < len(run):
                    piece = run.iloc[at : at + most - size]
                    held.append(piece)
                    at, size = at + len(piece), size + len(piece)
                    if size >= most:
                        yield from tile()
        yield from tile()

    return scratch.stored(dealt.mapInPandas(cut, f"`{by}` {kind[by]}, tile long, size int, low array<double>, high array<double>, ids array<{kind['id']}>, groups array<{kind['grp']}>, x array<double>"), "tiles")


def tile_pairs(made: DataFrame, by: str, keep: Column, given: DataFrame | None = None) -> DataFrame:
    """by, own, guest: the pairs of different tiles of a group that keep lets through; either may be the owner.

    keep is over low_a, high_a, low_b, high_b and the columns of `given`, one row per group.
    """
    a, b = (made.select(by, *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high")]) for s in "ab")
    both = (a if given is None else a.join(given, by)).join(b, by).filter("tile_a < tile_b").filter(keep)
    first = F.col("tile_a").bitwiseXOR(F.col("tile_b")) % 2 == 0  # so that no tile owns all its pairs
    return both.select(by, F.when(first, F.col("tile_a")).otherwise(F.col("tile_b")).alias("own"), F.when(first, F.col("tile_b")).otherwise(F.col("tile_a")).alias("guest"))


def can_meet(angle: float) -> Column:
    """Tile pairs that may hold a pair at most this angle apart: by the triangle inequality no pivot tells them further apart."""
    gap = lambda i: F.greatest(F.get("low_a", i) - F.get("high_b", i), F.get("low_b", i) - F.get("high_a", i))
    return F.forall(F.sequence(F.lit(0), F.size("low_a")), lambda i: F.coalesce(gap(i), F.lit(0.0)) <= angle + SPARE)


def compared(made: DataFrame, pairs: DataFrame | None, by: str, work, schema: str) -> DataFrame:
    """work(own, guest) over every tile with itself (guest None) and over the pairs; a tile travels once as owner, and once per pair as guest.

    own and guest are rows with ids, groups and x as a matrix. Owners come first in the order of their task, so that one tile and one guest are held at a time.
    """
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = made.select(by, "tile", "size", "ids", "groups", "x")
    stream = body.select(by, F.col("tile").alias("own"), F.lit(0).alias("turn"), *body.columns[1:])
    if pairs is not None:
        guests = pairs.join(body.withColumnRenamed("tile", "guest"), [by, "guest"]).withColumnRenamed("guest", "tile")
        stream = stream.union(guests.select(by, "own", F.lit(1).alias("turn"), *body.columns[1:]))
    dealt = stream.repartition(n, by, "own").sortWithinPartitions(by, "own", "turn", "tile")

    def run(frames):
        own = None
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                tile = (row[0], list(row.ids), np.asarray(row.groups, object), np.asarray(row.x, float).reshape(row.size, -1))
                if row.turn == 0:
                    own = tile
                yield from work(own, None if row.turn == 0 else tile)

    columns = [c.split()[0].strip("`") for c in schema.split(", ")]
    return dealt.mapInPandas(_joined(run, columns), schema)


def _angle(distance: float) -> float:
    return math.acos(max(-1.0, min(1.0, 1 - distance)))


def _tiled(vectors: DataFrame, by: str, max_distance: float) -> DataFrame:
    """Tiles of vectors (by, id, grp, v) around pivots of all of them. Zero vectors, 1 from all, take part only if that is near."""
    rows = turned(vectors, pivots(vectors))
    return tiles(rows if max_distance > 1 else rows.filter("cell >= 0"), by)


def skipped_share(vectors: DataFrame, by: str, max_distance: float) -> tuple[int, int]:
    """(pairs of different tiles that are compared, pairs there are) for a bound on the distance; vectors: by, id, v."""
    made = _tiled(vectors.select(by, "id", F.lit(0).alias("grp"), "v").filter(F.col(by).isNotNull()), by, max_distance)
    there = made.groupBy(by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    return tile_pairs(made, by, can_meet(_angle(max_distance))).count(), int(there or 0)


def similar_pairs(vectors: DataFrame, max_distance: float, limit: int | None = 30, method: str = "exact", dim: int | None = None, planes: int = 8, tables: int = 12) -> DataFrame:
    """a, b, distance: pairs of different groups (columns id, grp, v) under max_distance, nearest first; limit None: all of them, which may be very many.

    exact first looks for near pairs inside tiles; the limit-th nearest of them bounds the angle, and only tile pairs that may hold
    a nearer one are compared. lsh compares rows that share a signature (an approximation, see lsh_recall).
    """
    kind = vectors.schema["id"].dataType.simpleString()
    a, b = (vectors.select(F.col("id").alias(s), F.col("grp").alias(f"g_{s}"), F.col("v").alias(f"v_{s}")) for s in "ab")

    def exactly(both: DataFrame) -> DataFrame:
        found = both.join(a, "a").join(b, "b").select("a", "b", cosine_distance(F.col("v_a"), F.col("v_b")).alias("distance")).filter(F.col("distance") < max_distance)
        return found if limit is None else found.orderBy("distance", "a", "b").limit(limit)

    if method == "lsh":
        own = vectors.select("id", "grp", F.explode(signatures(F.col("v"), dim, planes, tables)).alias("sig"))
        return exactly(own.toDF("a", "g_a", "sig").join(own.toDF("b", "g_b", "sig"), "sig").filter("a < b and g_a <> g_b").select("a", "b").distinct())

    def near(bound: float):
        def work(own, guest):
            nonlocal bound
            _, ids, grp, x = own
            _, other_ids, other_grp, y = guest or own
            away = 1 - x @ y.T
            away[grp[:, None] == other_grp[None, :]] = np.inf
            if guest is None:
                away[np.tril_indices(len(ids))] = np.inf
            if limit is not None and away.size > limit:
                bound = min(bound, float(np.partition(away.ravel(), limit - 1)[limit - 1]))
            hits = np.argwhere((away <= bound + 1e-9) & np.isfinite(away)).tolist()
            yield pd.DataFrame([sorted((ids[i], other_ids[j])) for i, j in hits], columns=["a", "b"])

        return work

    made = _tiled(vectors.select(F.lit(0).alias("all"), "id", "grp", "v"), "all", max_distance)
    bound, schema = max_distance, f"a {kind}, b {kind}"
    if limit is not None:
        inside = exactly(compared(made, None, "all", near(bound), schema)).agg(F.count("*").alias("n"), F.max("distance").alias("far")).first()
        bound = inside.far if inside.n == limit else bound
    return exactly(compared(made, tile_pairs(made, "all", can_meet(_angle(bound))), "all", near(bound), schema))


def _joined(work, columns: list[str], rows: int = 10_000):
    """work's many small frames as few larger ones."""

    def run(frames):
        held, n = [], 0
        for pdf in work(frames):
            held.append(pdf)
            n += len(pdf)
            if n >= rows:
                yield pd.concat(held)
                held, n = [], 0
        yield pd.concat(held) if held else pd.DataFrame(columns=columns)

    return run


def match_within(vectors: DataFrame, by: str, max_distance: float) -> DataFrame:
    """a, b: enough links between the rows of one group (columns by, id, v) under max_distance to connect all that are connected.

    Only tile pairs that may hold a near pair are compared; each emits a spanning forest of its links, never the links themselves.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def work(own, guest):
        _, ids, _, x = own
        _, other_ids, _, y = guest or own
        names = ids if guest is None else ids + other_ids
        label, shift = np.arange(len(names)), 0 if guest is None else len(ids)
        near = 1 - x @ y.T < max_distance
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            linked = np.unique(label[np.append(np.flatnonzero(near[i]) + shift, i)])
            if len(linked) > 1:
                label[np.isin(label, linked)] = linked[0]
        moved = np.flatnonzero(label != np.arange(len(names))).tolist()
        yield pd.DataFrame([(names[i], names[label[i]]) for i in moved], columns=["a", "b"])

    made = _tiled(vectors.select(by, "id", F.lit(0).alias("grp"), "v").filter(F.col(by).isNotNull()), by, max_distance)
    return compared(made, tile_pairs(made, by, can_meet(_angle(max_distance))), by, work, f"a {kind}, b {kind}")


def widest(vectors: DataFrame, by: str) -> DataFrame:
    """by, size, far: the largest cosine distance between two rows of a group (by, id, v); 0 for a row alone.

    Three members are the group's pivots: its first, the one furthest from that, and the one furthest from the second. The angles between them
    are a lower bound; what two tiles can hold is at most the sum of their largest angles to a pivot, so only pairs of tiles that may exceed the bound are compared.
    A zero vector is 1 from all others.
    """
    rows = vectors.select(by, "id", F.col("v").cast("array<double>").alias("v")).withColumn("zero", dot(F.col("v"), F.col("v")) <= 0)
    sizes = rows.groupBy(by).agg(F.count("*").alias("size"), F.max("zero").alias("has_zero"))
    some = rows.filter("not zero").drop("zero")
    turn = lambda p: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1 - cosine_distance(F.col("v"), F.col(p)))))
    first = some.groupBy(by).agg(F.min_by("v", "id").alias("p0"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    some = some.join(first, by).withColumn("t0", turn("p0")).drop("p0")
    second = some.groupBy(by).agg(F.max_by("v", F.struct("t0", "id")).alias("p1"))
    some = scratch.stored(some.join(second, by).withColumn("t1", turn("p1")).drop("p1"), "turned")
    third = some.groupBy(by).agg(F.max_by("v", F.struct("t1", "id")).alias("p2"))
    some = some.join(third, by).withColumn("turns", F.array("t0", "t1", turn("p2"))).drop("p2")
    made = tiles(some.select(by, "id", F.lit(0).alias("grp"), "v", "turns", F.lit(0).alias("cell"), F.col("t1").alias("turn")), by)
    # the pivots are members, so their angles are angles of pairs
    least = made.groupBy(by).agg(F.max(F.array_max("high")).alias("least"))
    sums = [F.get("high_a", F.lit(i)) + F.get("high_b", F.lit(i)) for i in range(3)]
    pairs = tile_pairs(made, by, F.least(*sums) > F.col("least") - SPARE, least)

    def work(own, guest):
        _, _, _, x = own
        y = (guest or own)[3]
        yield pd.DataFrame([(own[0], float(max(0.0, (1 - x @ y.T).max())) if len(x) > 1 or guest is not None else 0.0)], columns=[by, "far"])

    kind = vectors.schema[by].dataType.simpleString()
    far = compared(made, pairs, by, work, f"`{by}` {kind}, far double").groupBy(by).agg(F.max("far").alias("far"))
    zero = F.when(F.col("has_zero") & (F.col("size") > 1), 1.0).otherwise(0.0)
    return sizes.join(far, by, "left").select(by, "size", F.greatest(F.coalesce("far", F.lit(0.0)), zero).alias("far"))


def nearest_k(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """query, item, distance, rank: the k nearest items (id, v) of each query (id, v).

    Items are a taxonomy or other vocabulary whose size the corpus doesn't change; the optimiser broadcasts them if they are small.
    """
    q, i = queries.select(F.col("id").alias("query"), F.col("v").alias("qv")), items.select(F.col("id").alias("item"), F.col("v").alias("iv"))
    scored = q.join(i, F.lit(True)).select("query", "item", cosine_distance(F.col("qv"), F.col("iv")).alias("distance"))
    w = Window.partitionBy("query").orderBy("distance", "item")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lsh_recall(max_distance: float, planes: int, tables: int) -> float:
    """The share of pairs at this cosine distance that the signatures are expected to find."""
    same = 1 - math.acos(max(-1.0, 1 - max_distance)) / math.pi
    return 1 - (1 - same**planes) ** tables
