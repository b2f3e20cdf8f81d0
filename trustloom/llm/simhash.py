"""SimHash near-duplicates: fingerprints that share a stretch of bits are compared, exactly.

Equal fingerprints collapse first, so copies cost nothing further. The 64 bits are cut into one stretch more than the radius:
two fingerprints within the radius agree on one stretch at least, so only those that share one meet, and no pair is lost.
Sharers of a stretch are compared bit by bit (exclusive-or and bit counts in numpy), many small groups in one task; groups over a tile's size are
cut into tiles that meet pairwise. A comparison emits a spanning forest of the links it found, never the pairs
themselves: that keeps every connection and bounds the rows by the members of groups.

Nulls, empty texts and texts of white space: fingerprint zero, linked like any other. Texts with fewer words than a shingle:
one shingle of all words. Null ids: they take no part in the choice of the component's smallest id, and get it like
the rest (null if no member has an id). Repeated rows get a row each. Other columns are not read.

`one_of_each` is for a contract on similarity: texts are linked if their sets of shingles have a Jaccard similarity of so much at
least. Equal sets collapse. Sets that share one of their KEYS smallest hashes meet, and are candidates if their fingerprints (of the sets) are within a
wider radius. Two exact bounds thin them out: the sizes of similar sets differ by the similarity at most, and sets differ by as
much at least as counts of their hashes by residue do. Components of candidates, in parts of bounded size, then get the sets
themselves and emit a spanning forest of the pairs that are similar.

What can lose a pair is the radius, and for sets of 5 * KEYS hashes and more their smallest hashes: none is shared only if of the union's hashes, in their
order, KEYS that one set alone has come before the first that both have; at a similarity of 0.8 that has a probability of 0.2^16 (under
1e-11) at most. Smaller sets share one surely, as a similar set lacks less than KEYS of their hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .memory import release, small_batches

TILE = 8192
_STRIP = 128
#: Runs of rows with one key from this length on are compared as matrices; rows in a unit of small groups.
_LONG, UNIT = 64, 1 << 16
_HASHES = 1 << 15
#: For one_of_each: at 0.8, fingerprints of sets differ by 9.7 bits on average, with a standard deviation of 2.9.
WIDE_RADIUS = 18
WIDE_TILE = 4096
WIDE_UNIT = 1 << 14
KEYS = 16
_RESIDUES = 64
#: Names of a pair of tiles.
PAIR = ["p_left", "p_left_part", "p_right", "p_right_part"]
_PAIRS = 1 << 16
#: Members and bytes of one part of a component of candidates.
PART, PART_BYTES = 512, 8 << 20
#: A hash in more than so many sets of two parts is counted by a product of matrices, of so many columns at once.
_FEW, _COLUMNS = 16, 2048


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text as an unsigned number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    a, b = start[:n].tolist(), end[-n:].tolist()
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _HASHES):
        h = np.fromiter([digest(joined[x:y], 42) for x, y in zip(a[i : i + _HASHES], b[i : i + _HASHES], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(text_col: str, shingle: int = 4):
    """The fingerprint of a text column as a signed 64-bit column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts)).view(np.int64)
        release()
        return pd.Series(out)

    return of(F.col(text_col))


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of x and y, pair by pair. A label is the least place of its group."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _link(label: np.ndarray, who: np.ndarray, f: np.ndarray, radius: int, accept, left: slice, right: slice) -> None:
    """Join the places that rows of left and of right stand for (who), if their fingerprints are near and accept takes the pair."""
    for at in range(left.start, left.stop, _STRIP):
        to = min(at + _STRIP, left.stop)
        low = max(right.start, at + 1 if left == right else right.start)
        i, j = np.nonzero(np.bitwise_count(f[at:to, None] ^ f[None, low : right.stop]) <= radius)
        i, j = who[i + at], who[j + low]
        for k in range(0, len(i), _PAIRS):
            _take(label, i[k : k + _PAIRS], j[k : k + _PAIRS], accept)


def _take(label: np.ndarray, x: np.ndarray, y: np.ndarray, accept) -> None:
    apart = label[x] != label[y]
    x, y = x[apart], y[apart]
    if accept is not None and len(x):
        ok = accept(x, y)
        x, y = x[ok], y[ok]
    if len(x):
        _merge(label, x, y)


def _link_runs(label: np.ndarray, who: np.ndarray, key: np.ndarray, f: np.ndarray, radius: int, accept=None) -> None:
    """The same for all pairs of rows with one key. Rows are in order of their keys; short runs are compared side by side, a distance at a time."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cut)
    for start, n in zip(cut[:-1][size >= _LONG].tolist(), size[size >= _LONG].tolist(), strict=True):
        run = slice(start, start + n)
        _link(label, who, f, radius, accept, run, run)
    after = np.where(np.repeat(size, size) < _LONG, np.repeat(cut[1:], size) - np.arange(len(key)) - 1, 0)  # rows of the run behind each
    at, d = np.flatnonzero(after), 1
    while len(at):
        hit = at[np.bitwise_count(f[at] ^ f[at + d]) <= radius]
        if len(hit):
            _take(label, who[hit], who[hit + d], accept)
        d += 1
        at = at[after[at] >= d]


def stretches(prints: DataFrame, col: str, radius: int) -> DataFrame:
    """f, key: each fingerprint with the keys of its stretches of bits, one more than the radius."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    stretch = lambda i: F.shiftleft(F.shiftrightunsigned("f", ends[i]), 64 - ends[i + 1] + ends[i])
    keys = F.array(*[F.xxhash64(F.lit(i), stretch(i)) for i in range(radius + 1)])
    return prints.select(F.col(col).alias("f")).select("f", F.explode(keys).alias("key"))


def links(prints: DataFrame, col: str, radius: int = 4, tile: int = TILE) -> DataFrame:
    """a, b: enough links between different fingerprints within the radius to connect all that are connected."""
    keyed = stretches(prints, col, radius)

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        f = pdf["f"].to_numpy(np.int64)
        node, who = np.unique(f, return_inverse=True)
        label = np.arange(len(node))
        _link_runs(label, who, pdf["key"].to_numpy(np.int64), f.view(np.uint64), radius)
        release()
        return _forest_of(node, label)

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.asarray(x, np.int64) for x in pdf.sort_values("side").f]
        node = np.concatenate(lists)
        label, cut = np.arange(len(node)), len(lists[0])
        _link(label, label.copy(), node.view(np.uint64), radius, None, slice(0, cut), slice(0 if len(lists) == 1 else cut, len(node)))
        release()
        return _forest_of(node, label)

    return _meet(keyed, keyed.groupBy("key").agg(F.count("*").alias("m")), ["f"], tile, UNIT, small, large)


def _meet(keyed: DataFrame, counts: DataFrame, values: list[str], tile: int, unit: int, small, large) -> DataFrame:
    """a, b from all pairs of rows of one key. keyed: key and values; counts: key, m (its rows). Keys up to a tile's size go to small, some `unit` rows at once; of the
    others large gets each pair of tiles, a tile paired with itself once."""
    spark = keyed.sparkSession
    heavy = scratch.stored(counts.filter(F.col("m") > tile).select("key", F.ceil(F.col("m") / tile).cast("int").alias("parts")), "heavy")
    units = max(1, -(-keyed.count() // unit))
    rest = keyed.join(heavy, "key", "left_anti").withColumn("unit", F.pmod("key", F.lit(units)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(units, 1 << 15))
    found = rest.repartition(n, "unit").groupBy("unit").applyInPandas(small, "a long, b long")
    if heavy.isEmpty():
        return found
    part = F.pmod(F.xxhash64(*values[:1]), "parts").alias("part")
    tiles = keyed.join(heavy, "key").groupBy("key", part, "parts").agg(*[F.collect_list(c).alias(c) for c in values])
    tiles = scratch.stored(tiles, "tiles")
    pairs = tiles.select("key", "part", F.col("key").alias("key2"), F.explode(F.sequence(F.col("part").cast("int"), F.col("parts") - 1)).alias("part2"))
    dealt = _deal(tiles, pairs, ["key", "part"], ["key2", "part2"], values)
    return found.union(dealt.groupBy(*PAIR).applyInPandas(large, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (signed), root (a fingerprint that stands for the component), component_id (its smallest id)."""
    small_batches(docs.sparkSession)
    rows = scratch.stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(text_col, shingle).alias("fingerprint")), "fingerprints")
    prints = scratch.stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    member = components(links(prints, "fingerprint", radius), "a", "b")
    linked = scratch.stored(prints.join(member, prints.fingerprint == member.node).select("fingerprint", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    chosen = scratch.stored(linked.join(least, "root").select("fingerprint", "root", "least"), "chosen")
    classes = scratch.stored(prints.join(chosen, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "classes")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "root", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Every text of documents with its fingerprint and the smallest id of its near-duplicate component."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), "<u8", n))


def signatures(text_col: str, shingle: int):
    """node (a hash of the set of shingles), f (the set's fingerprint), n (its size), counts (hashes by residue, 255 at most), keys (the smallest hashes)."""

    @F.pandas_udf("node long, f long, n int, counts binary, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for x in texts:
            h = shingle_set(x, shingle)
            votes = np.zeros(64, np.int64)
            for i in range(0, len(h), _HASHES):
                votes += np.unpackbits(h[i : i + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            f = np.packbits(2 * votes > len(h), bitorder="little").view("<i8")[0]
            counts = np.minimum(np.bincount((h % np.uint64(_RESIDUES)).astype(np.int64), minlength=_RESIDUES), 255)
            out.append((np.uint64(xxhash.xxh64_intdigest(h.tobytes())).astype(np.int64), f, len(h), counts.astype(np.uint8).tobytes(), h[:KEYS].view(np.int64)))
        release()
        return pd.DataFrame(out, columns=["node", "f", "n", "counts", "keys"])

    return of(F.col(text_col))


def _forest_of(node: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    moved = np.flatnonzero(label != np.arange(len(node)))
    return pd.DataFrame({"a": node[moved], "b": node[label[moved]]}, dtype="int64")


def _deal(tiles: DataFrame, pairs: DataFrame, left: list[str], right: list[str], values: list[str]) -> DataFrame:
    """PAIR, side, values: the tiles of each pair, which goes by its two tiles' names; a tile paired with itself comes once."""
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = pairs.select(*left, *right, *[F.col(c).alias(p) for c, p in zip(left + right, PAIR, strict=True)])
    other = " or ".join(f"{a} <> {b}" for a, b in zip(left, right, strict=True))
    ends = named.select(*PAIR, *left, F.lit(0).alias("side")).union(named.filter(other).select(*PAIR, *right, F.lit(1)))
    return ends.join(tiles, left).select(*PAIR, "side", *values).repartition(n, *PAIR)


def candidates(nodes: DataFrame, radius: int, similarity: float, tile: int = WIDE_TILE) -> DataFrame:
    """a, b: enough links to connect all pairs of nodes (node, f, n, counts, keys) that share a key, are within the radius, and may be as similar."""
    loose = (1 - similarity) / (1 + similarity)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key")  # most keys are in one set only
    shared = scratch.stored(shared, "shared")
    told = scratch.stored(shared.join(nodes.select("node", "f", "n", "counts"), "node").drop("m"), "told")

    def accept_of(n: np.ndarray, counts: np.ndarray):
        def accept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            ok = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6
            at = np.flatnonzero(ok)
            ok[at] = np.abs(counts[x[at]] - counts[y[at]]).sum(axis=1, dtype=np.int64) <= loose * (n[x[at]] + n[y[at]]) + 1e-6
            return ok

        return accept

    def spread(counts) -> np.ndarray:
        return np.frombuffer(b"".join(counts), np.uint8).reshape(-1, _RESIDUES).astype(np.int16)

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        node, first, who = np.unique(pdf["node"].to_numpy(np.int64), return_index=True, return_inverse=True)
        label = np.arange(len(node))
        accept = accept_of(pdf["n"].to_numpy(np.int64)[first], spread(pdf["counts"].iloc[first]))
        _link_runs(label, who, pdf["key"].to_numpy(np.int64), pdf["f"].to_numpy(np.int64).view(np.uint64), radius, accept)
        release()
        return _forest_of(node, label)

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        node, f, n = (np.concatenate([np.asarray(x, np.int64) for x in pdf[c]]) for c in ("node", "f", "n"))
        label, cut = np.arange(len(node)), len(pdf["node"].iloc[0])
        accept = accept_of(n, spread(x for tile in pdf["counts"] for x in tile))
        _link(label, label.copy(), f.view(np.uint64), radius, accept, slice(0, cut), slice(0 if len(pdf) == 1 else cut, len(node)))
        release()
        return _forest_of(node, label)

    return _meet(told, shared.groupBy("key").agg(F.count("*").alias("m")), ["node", "f", "n", "counts"], tile, WIDE_UNIT, small, large)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes the sets i < j share, at [i, j]. Hashes in few sets are counted pair by pair, the others by products of matrices."""
    m = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), np.fromiter(map(len, sets), np.int64, m))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    size = np.diff(cut)
    after = np.where(np.repeat(size, size) <= _FEW, np.repeat(cut[1:], size) - np.arange(len(flat)) - 1, 0)
    both, at, d = np.zeros(m * m, np.float32), np.flatnonzero(after), 1
    while len(at):
        both += np.bincount(owner[at] * m + owner[at + d], minlength=m * m)
        d += 1
        at = at[after[at] >= d]
    both = both.reshape(m, m)
    many = np.flatnonzero(size > _FEW)
    for k in range(0, len(many), _COLUMNS):
        runs = many[k : k + _COLUMNS]
        of = np.repeat(np.arange(len(runs)), size[runs])
        start = np.repeat(cut[runs] - np.concatenate([[0], np.cumsum(size[runs])[:-1]]), size[runs])
        held = np.zeros((m, len(runs)), np.float32)
        held[owner[start + np.arange(len(of))], of] = 1
        both += held @ held.T
    return both


def _parts():
    return F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum(F.length("shingles")) / PART_BYTES)).alias("parts")


def similar_links(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: enough links to connect all similar pairs inside components. members: root, node, shingles (hashes, packed).

    Components of one part share bins of about a part's size; only pairs of one component count. Of the others, all parts first meet the first of them.
    Where there are more than two, members are dealt out again by what they are linked with: large groups of linked members needn't meet themselves, all else does.
    """
    lists = [F.collect_list(c).alias(c) for c in ("comp", "node", "shingles")]
    bins = members.agg(_parts()).first().parts or 1
    dealt = members.join(members.groupBy("root").agg(_parts()), "root").withColumn("comp", F.col("root")).withColumn("root", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")))
    tiles = dealt.groupBy("root", F.pmod(F.xxhash64("node"), "parts").alias("part"), "parts").agg(*lists)
    tiles = scratch.stored(tiles, "parts")
    pairs = tiles.select("root", F.col("part").alias("part2")).join(tiles.groupBy("root").agg(F.min("part").alias("part")), "root").withColumn("root2", F.col("root"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        comp, node = (np.concatenate([np.asarray(x, np.int64) for x in pdf[c]]) for c in ("comp", "node"))
        sets = [np.frombuffer(x, "<u8") for part in pdf["shingles"] for x in part]
        sizes, label = np.fromiter(map(len, sets), np.float64, len(sets)), np.arange(len(sets))
        both = _shared(sets)
        x, y = np.nonzero(np.triu(both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9, 1))
        same = comp[x] == comp[y]
        _merge(label, x[same], y[same])
        release()
        return _forest_of(node, label)

    def met(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy(*PAIR).applyInPandas(compare, "a long, b long")

    first = met(_deal(tiles, pairs, ["root", "part"], ["root2", "part2"], ["comp", "node", "shingles"]))
    many = tiles.filter("parts > 2").select("root").distinct()
    if many.isEmpty():
        return first
    first = scratch.stored(first, "first")
    label = components(first, "a", "b").select("node", F.col("root").alias("label"))
    again = members.join(many, "root").withColumn("comp", F.col("root")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    solid = again.groupBy("root", "label").agg(F.count("*").alias("m")).filter(F.col("m") >= PART).select("label", F.lit(True).alias("solid"))
    again = scratch.stored(again.join(solid, "label", "left").withColumn("label", F.when(F.col("solid"), F.col("label"))), "again")  # null: not in a large group
    sizes = again.groupBy("root", "label").agg(_parts()).select(F.col("root").alias("r"), F.col("label").alias("l"), "parts")
    parts = again.join(sizes, (F.col("root") == F.col("r")) & F.col("label").eqNullSafe(F.col("l")))
    tiles = parts.groupBy("root", "label", F.pmod(F.xxhash64("node"), "parts").alias("part")).agg(*lists)
    tiles = scratch.stored(tiles.withColumn("name", F.xxhash64(F.array(F.col("root"), F.coalesce("label", "root"), F.col("label").isNull().cast("long"), "part"))), "groups")
    left, right = (tiles.select("root", F.col("label").alias(f"l{i}"), F.col("name").alias(f"n{i}")) for i in (0, 1))
    pairs = left.join(right, "root").filter("n0 <= n1 and (l0 is null or l1 is null or l0 <> l1)")
    pairs = pairs.select(F.col("n0").alias("name"), "root", F.col("n1").alias("name2"), F.col("root").alias("root2"))
    return first.union(met(_deal(tiles, pairs, ["name", "root"], ["name2", "root2"], ["comp", "node", "shingles"])))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """Of each component of similar texts the row of docs with the smallest id (any of them, where ids repeat or are null)."""
    small_batches(docs.sparkSession)
    signed = docs.select(F.struct(*docs.columns).alias("doc"), F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id")).alias("order"), signatures(text_col, shingle).alias("s"))
    once = signed.select("doc", "order", "s.*").groupBy("node").agg(F.min_by("doc", "order").alias("doc"), F.min("order").alias("order"), *[F.any_value(c).alias(c) for c in ("f", "n", "counts", "keys")])
    once = scratch.stored(once, "once")
    member = scratch.stored(components(candidates(once.select("node", "f", "n", "counts", "keys"), radius, similarity), "a", "b"), "members")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(x, shingle).tobytes() for x in texts], dtype=object)

    sets = once.select("node", F.col("doc")[text_col].alias("text")).join(member, "node")
    sets = scratch.stored(sets.select("root", "node", packed("text").alias("shingles")), "sets")
    linked = scratch.stored(components(similar_links(sets, similarity), "a", "b"), "linked")
    ranked = once.select("node", F.struct("order", "node").alias("rank")).join(linked, "node")
    ranked = scratch.stored(ranked, "ranked")
    least = ranked.groupBy("root").agg(F.min("rank").alias("least"))
    gone = ranked.join(least, "root").filter("rank <> least").select("node")
    return once.join(gone, "node", "left_anti").select("doc.*")
