"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups' roots, and a proof per leaf.

Leaves are numbered inside their group through one range exchange (rows to ranges; offsets from the counts of ranges, so no group is held by a task). Levels are built
STEP at a time: 2**STEP nodes, which share an ancestor, meet in a row, and all levels up to that ancestor are folded there. What is stored are node rows
that link to the ancestor, with the siblings on the way. Proofs are then climbed: a recursive query starts with the leaves,
joins a row's node with the stored rows, appends the siblings, folds the digest and goes on with the ancestor. Low steps join by
exchange, two in a query, where a node is met by few leaves; as soon as all node rows above are at most BROADCAST_NODES (they are counted), one query climbs the rest and broadcasts them.
A row's result is kept as a table per query.

Nulls: a null field is written as `-`; null groups are one group, the first; null keys come first in it and are never tampered with. Repeated rows and rows that repeat a key are leaves of
their own (ordered by key, then digest). Empty texts count as texts of no bytes. Very long texts are hashed where they are read; only digests move. Other columns aren't read. No rows: no leaves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Levels that a node row climbs.
STEP = 4
#: At most so many node rows (of about 250 bytes) are broadcast.
BROADCAST_NODES = 20_000
#: Rows of one file of climbed leaves, about.
FILE_ROWS = 20_000
#: Rows that repeat group, key and digest are dealt to ranges by so many salts.
SALT = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROWS = "spark.sql.cteRecursionRowLimit"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other, each as its number of UTF-8 bytes, a colon and its text, or `-` if null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return _sha(F.concat(*[part(c) for c in fields]))


def numbered(rows: DataFrame, by: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with tree and at, trees): groups are numbered in the order of `by`, rows inside them in the given order; trees: by, tree, size.

    Each group is cut at the borders of ranges, so offsets are sums over at most one count per range and group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.monotonically_increasing_id() % SALT)
    sorted_ = salted.repartitionByRange(n, by, *order, "_salt").sortWithinPartitions(by, *order).drop("_salt")
    kept = scratch.stored(sorted_.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")), "leaves")
    runs = scratch.stored(kept.groupBy("_part", by).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n")), "runs")
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")
    sizes = runs.groupBy(by).agg(F.sum("_n").alias("size"))
    if by == "_all":
        trees = sizes.withColumn("tree", F.lit(0).cast("long"))
    else:
        trees = numbered(sizes.withColumnsRenamed({"size": "leaves"}).withColumn("_all", F.lit(0)), "_all", [by])[0].select(by, F.col("at").alias("tree"), F.col("leaves").alias("size"))
    trees = scratch.stored(trees, "trees")
    places = runs.withColumn("_before", before).withColumnsRenamed({by: "_by", "_part": "_p"}).drop("_n")
    places = places.join(trees.withColumnRenamed(by, "_t"), F.col("_by").eqNullSafe(F.col("_t"))).drop("_t")
    out = kept.join(places, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.withColumn("at", F.col("_seq") - F.col("_first") + F.col("_before")).drop("_part", "_p", "_by", "_seq", "_first", "_before"), trees


def _height(size: str) -> Column:
    """Levels above the leaves until one node is left."""
    return F.when(F.col(size) > 1, F.length(F.bin(F.col(size) - 1))).otherwise(0)


def node_id(level, at) -> Column:
    return F.shiftleft(level.cast("long"), 48) + at


def _step(nodes: DataFrame, level: int) -> DataFrame:
    """The node rows of a level (tree, height, at, digest): node, parent (STEP levels up or the root), siblings on the way, and up: the parent's digest, on its first row only."""
    above = F.least(F.lit(STEP), F.col("height") - level)
    rows = nodes.groupBy("tree", "height", F.shiftright("at", STEP).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]).alias("first"))
    pair = lambda last, i: _sha(F.concat(hexed(F.get(last, 2 * i)), F.coalesce(hexed(F.get(last, 2 * i + 1)), F.lit(""))))
    halved = lambda last: F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / 2).cast("int")), lambda i: pair(last, i))
    grown = F.aggregate(F.sequence(F.lit(1), above), F.array("first"), lambda done, _: F.concat(done, F.array(halved(F.element_at(done, -1)))))
    each = rows.withColumn("rows", grown).select("tree", "height", "block", "rows", F.posexplode("first").alias("i", "digest")).withColumn("above", F.size("rows") - 1)
    beside = F.expr("transform(slice(rows, 1, above), (row, j) -> get(row, shiftright(i, j) ^ 1))")
    at = F.shiftleft("block", STEP) + F.col("i")
    parent = node_id(F.col("above") + level, F.expr(f"shiftright(shiftleft(block, {STEP}) + i, above)"))
    return each.select("tree", "height", node_id(F.lit(level), at).alias("node"), parent.alias("parent"), beside.alias("siblings"), F.when(F.col("i") == 0, F.get(F.element_at("rows", -1), F.lit(0))).alias("up"))


def built(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(node rows step by step, roots: tree, root) of leaves (tree, height, at, digest); a tree ends at its own height."""
    steps, level = [], 0
    highest = leaves.agg(F.max("height")).first()[0] or 0
    roots = leaves.filter("height = 0").select("tree", F.col("digest").alias("root"))
    below = leaves.filter("height > 0").select("tree", "height", "at", "digest")
    while level < highest:
        steps.append(scratch.stored(_step(below, level), "nodes"))
        tops = steps[-1].filter("up is not null")
        roots = roots.union(tops.filter(f"height <= {level + STEP}").select("tree", "up"))
        below = tops.filter(f"height > {level + STEP}").select("tree", "height", F.expr("parent & ((1L << 48) - 1)").alias("at"), F.col("up").alias("digest"))
        level += STEP
    return steps, roots


CLIMB = """
with recursive climb(tree, node, folded, proof, {names}) as (
  select tree, node, folded, proof, {names} from {{starts}}
  union all
  select {hint} c.tree, n.parent,
         aggregate(sequence(0, size(n.siblings) - 1), c.folded, (d, i) -> unhex(sha2(
           case when n.siblings[i] is null then lower(hex(d)) when shiftright(n.node, i) & 1 = 1 then concat(lower(hex(n.siblings[i])), lower(hex(d))) else concat(lower(hex(d)), lower(hex(n.siblings[i]))) end, 256))),
         aggregate(n.siblings, c.proof, (p, s) -> concat(p, coalesce(s, X''))), {carried}
  from climb c join {{nodes}} n on n.tree = c.tree and n.node = c.node where shiftright(c.node, 48) < least(c.height, {top})
)
select * from climb where shiftright(node, 48) = least(height, {top})
"""


def climbed(starts: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """starts (tree, height, node, folded, proof and others), each row at its root: proof with the siblings' digests appended, folded with theirs folded in."""
    spark, low = starts.sparkSession, 0
    before = spark.conf.get(_ROWS)
    rows = [s.count() for s in steps]
    files = max(1, starts.count() // FILE_ROWS)
    while low < len(steps):
        small = sum(rows[low:]) <= BROADCAST_NODES
        high = len(steps) if small else min(low + 2, len(steps))
        nodes = reduce(DataFrame.union, [s.select("tree", "node", "parent", "siblings") for s in steps[low:high]])
        others = [c for c in starts.columns if c not in ("tree", "node", "folded", "proof")]
        query = CLIMB.format(names=", ".join(f"`{c}`" for c in others), carried=", ".join(f"c.`{c}`" for c in others), hint="/*+ broadcast(n) */" if small else "", top=high * STEP)
        spark.conf.set(_ROWS, "-1")  # a row per leaf and step: as many as there are
        try:
            to = scratch.path(spark, "climb")
            done = spark.sql(query, starts=starts, nodes=nodes)
            done.coalesce(files).write.option("compression", "zstd").parquet(to)
        finally:
            spark.conf.set(_ROWS, before)
        starts, low = spark.read.schema(done.schema).parquet(to), high
    return starts


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", fields=FIELDS, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified, and proof (the siblings' digests in hexadecimal), a row per row.

    tampered: other values of some fields, for the rows that `when` selects; folded_root is the root that the other
    leaf gives with the original siblings.
    """
    of = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest(*[of(f) for f in fields])
    other = leaf_digest(*[(tampered or {}).get(f, of(f)) for f in fields])
    other = F.when(F.coalesce(when, F.lit(False)), other) if when is not None and tampered else F.lit(None).cast("binary")
    leaves, trees = numbered(rows.select(of(key).alias("key"), of(group).alias("grp"), leaf.alias("digest"), other.alias("other")), "grp", ["key", "digest"])
    leaves = scratch.stored(leaves.withColumn("height", _height("size")), "leaves")
    steps, roots = built(leaves)
    tops = roots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("root").alias("digest"))
    size = trees.count()
    tops = scratch.stored(tops.withColumn("height", F.lit((size - 1).bit_length() if size else 0)), "subroots")
    upper, root = built(tops)

    start = leaves.select("tree", "height", node_id(F.lit(0), F.col("at")).alias("node"), F.coalesce("other", "digest").alias("folded"), F.expr("X''").alias("proof"), "key", F.col("digest").alias("leaf"))
    below = climbed(start, steps)
    below = below.select(F.lit(-1).cast("long").alias("tree"), F.lit((size - 1).bit_length() if size else 0).alias("height"), node_id(F.lit(0), F.col("tree")).alias("node"), "folded", "proof", "key", "leaf", F.col("tree").alias("own"))
    done = climbed(below, upper)
    ends = tops.select(F.col("at").alias("own"), F.col("digest").alias("subroot"))
    found = root.first()
    out = done.join(F.broadcast(ends) if size <= BROADCAST_NODES else ends, "own").withColumn("root", F.lit(bytes(found["root"]) if found else b""))
    proof = hexed(F.col("proof"))
    return out.select(
        F.col("key").alias(key), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"), proof.alias("proof"),
    )


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; where 7 divides the crc32 of the id, one character is added to n_chars."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, tampered={"n_chars": more}, when=hit).drop("proof")


SQL = r"""
with recursive d as (select doc_id, source, lang, n_chars, text, cast(doc_id as varchar) as key from documents),
f as (select doc_id, lang, list_reduce(list_prepend(4294967295, list_transform(range(length(key)), lambda i: ascii(substr(key, cast(i + 1 as bigint), 1)))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) as crc,
   coalesce(strlen(key) || ':' || key, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
   cast(n_chars as varchar) as n, cast(n_chars + 1 as varchar) as more, coalesce(strlen(text) || ':' || text, '-') as tail from d),
h as (select doc_id, lang, xor(crc, 4294967295) % 7 = 0 as hit, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) as leaf, sha256(head || coalesce(strlen(more) || ':' || more, '-') || tail) as other from f),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from h),
lower_(lang, up, line) as (select lang, 0, list(leaf order by pos) from leaves group by lang
  union all select lang, up + 1, list_transform(range(0, len(line), 2), lambda i: sha256(line[i + 1] || coalesce(line[i + 2], ''))) from lower_ where len(line) > 1),
sub as (select lang, line[1] as subroot, row_number() over (order by lang nulls first) - 1 as own from lower_ where len(line) = 1),
upper_(up, line) as (select 0, list(subroot order by own) from sub
  union all select up + 1, list_transform(range(0, len(line), 2), lambda i: sha256(line[i + 1] || coalesce(line[i + 2], ''))) from upper_ where len(line) > 1),
climb(doc_id, lang, own, leaf, pos, up, folded, proof, high) as (
  select l.doc_id, l.lang, s.own, l.leaf, l.pos, 0, case when l.hit then l.other else l.leaf end, '', false from leaves l join sub s on s.lang is not distinct from l.lang
  union all
  select c.doc_id, c.lang, c.own, c.leaf, case when len(n.line) > 1 then c.pos // 2 else c.own end, case when len(n.line) > 1 then c.up + 1 else 0 end,
    case when len(n.line) = 1 then c.folded when c.pos % 2 = 1 then sha256(n.line[c.pos] || c.folded) else sha256(c.folded || coalesce(n.line[c.pos + 2], '')) end,
    case when len(n.line) = 1 then c.proof when c.pos % 2 = 1 then c.proof || n.line[c.pos] else c.proof || coalesce(n.line[c.pos + 2], '') end, c.high or len(n.line) = 1
  from climb c join (select lang, up, line, false as high from lower_ union all select null, up, line, true from upper_) n on n.high = c.high and n.up = c.up and (c.high or n.lang is not distinct from c.lang)
  where not (c.high and len(n.line) = 1))
select c.doc_id, c.leaf, s.subroot, r.root, sha256(c.proof) as proof_sha256, c.folded as folded_root, c.folded = r.root as verified
from climb c join sub s on s.own = c.own join (select up, line[1] as root from upper_ where len(line) = 1) r on c.high and c.up = r.up
"""
