"""Queries on vectors, entity resolution and the graph (V, E, G), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import graph as G
from ..operators import profile as P
from ..operators import resolve as R
from ..operators import vectors as V
from . import base as B

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- vectors -------------------------------------------------------------------------------------------------

NAMED = ("region", "nation", "customer", "supplier", "part", "orders")
_values = f"(select c.dataset, c.column_name, r.role, trim(c.value) as value, count(*) as n from ({B.sql_cells(NAMED)}) c join {B.sql_roles()} r on r.dataset = c.dataset and r.column_name = c.column_name where trim(c.value) <> '' group by all)"


def _cells_of_roles(spark, sf_dir):
    return B.cells(spark, sf_dir, NAMED).join(F.broadcast(B.role_table(spark).select("dataset", "column_name")), ["dataset", "column_name"])


@query(f"select dataset, column_name, value from {_values}")
def distinct_values(spark, sf_dir):
    """V1: all values of each column with a role."""
    return V.distinct_values(_cells_of_roles(spark, sf_dir), None).select("dataset", "column_name", "value")


_hash = """(with t as (select distinct {col} as key, lower(trim({col})) as s from {table}),
ch as (select key, unnest(range(0, len(s))) as i, s from t), co as (select key, i, ascii(s[i + 1]) as c from ch),
raw as (select key, (c * (i + 1)) % 1536 as idx, sum(sin(c + i)) as v from co group by all)
select key, idx, v / sqrt(sum(v * v) over (partition by key)) as w from raw)"""
_part_hash = _hash.format(col="p_name", table="part")


def _part_vectors(spark, sf_dir):
    return V.hash_embed(B.table(spark, sf_dir, "part").select("p_name").distinct(), "p_name", "p_name")


@query(f"select key, idx, round(w, 6) as w from {_part_hash}")
def hash_embed(spark, sf_dir):
    """V2: hash vectors of part names."""
    return _part_vectors(spark, sf_dir).select("key", F.col("idx").cast("long").alias("idx"), F.round("w", 6).alias("w"))


@query(f"""select p.p_partkey as key, case when e.vec_id is null then 'hash' else 'given' end as embedding_source, case when e.vec_id is null then 1536 else len(e.embedding) end as dim,
round(case when e.vec_id is null then h.total else list_sum(cast(e.embedding as double[])) end, 6) as total
from part p left join embeddings e on e.vec_id = p.p_partkey * 3 left join (select key, sum(w) as total from {_part_hash} group by 1) h on h.key = p.p_name""")
def attach_vectors(spark, sf_dir):
    """V3: a vector for every part: its own where one is given, else the hash vector of its name."""
    given = B.table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select((F.col("vec_id") / 3).cast("long").alias("p_partkey"), F.col("embedding").alias("vector"))
    out = V.attach_vectors(B.table(spark, sf_dir, "part").select("p_partkey", "p_name"), given, "p_partkey", "p_name")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return out.select(F.col("p_partkey").alias("key"), "embedding_source", F.size("vector").cast("long").alias("dim"), F.round(total, 6).alias("total"))


@query(f"select dataset, column_name, count(*) as n_values from {_values} where not (dataset = 'supplier' and column_name = 'suppkey') group by all")
def embed_entities(spark, sf_dir):
    """V4: how many values of each column get a vector once IDs beside a name are left out."""
    from ..operators import columns as C

    roles = B.role_table(spark).withColumn("samples", F.array().cast("array<string>")).withColumn("column_name", F.when(F.col("column_name") == "suppkey", "suppkey_id").otherwise(F.col("column_name")))
    kept, _ = C.pair_id_columns(roles)
    values = V.distinct_values(_cells_of_roles(spark, sf_dir), None)
    return values.join(F.broadcast(kept.select("dataset", "column_name")), ["dataset", "column_name"]).groupBy("dataset", "column_name").agg(F.count("*").alias("n_values"))


_cos = "1 - list_cosine_similarity(cast({0} as double[]), cast({1} as double[]))"


@query(f"select a.vec_id, round({_cos.format('a.embedding', 'b.embedding')}, 6) as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_distance(spark, sf_dir):
    """V5: the distance of each vector to the next."""
    e = B.table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query(f"select a, b, round(distance, 6) as distance from (select a.vec_id as a, b.vec_id as b, {_cos.format('a.embedding', 'b.embedding')} as distance from embeddings a join embeddings b on a.vec_id < b.vec_id and a.vec_id % 3 <> b.vec_id % 3) where distance < 0.7 order by distance, a, b limit 30")
def similar_pairs(spark, sf_dir):
    """V6: the 30 nearest pairs of vectors of different groups."""
    e = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("grp"), F.col("embedding").alias("v"))
    return V.similar_pairs(e, 0.7).withColumn("distance", F.round("distance", 6))


@query(f"select query, item, rn as rank from (select q.vec_id as query, i.vec_id as item, row_number() over (partition by q.vec_id order by {_cos.format('q.embedding', 'i.embedding')}, i.vec_id) as rn from embeddings q, (select embedding, vec_id from (select *, row_number() over (partition by label order by vec_id) as rn from embeddings) where rn = 1) i) where rn <= 5")
def nearest_k(spark, sf_dir):
    """V7: for each vector the nearest five of the labels' first vectors."""
    e = B.table(spark, sf_dir, "embeddings")
    items = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"), F.min("vec_id").alias("id"))
    return V.nearest_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), items.select("id", "v")).select("query", "item", F.col("rank").cast("long").alias("rank"))


# --- entity resolution ----------------------------------------------------------------------------------------

_near = f"(select a.key as a, b.key as b, 1 - sum(a.w * b.w) as distance from {_part_hash} a join {_part_hash} b on a.idx = b.idx and a.key < b.key group by all)"
_comp = f"""(with recursive e as (select a, b from {_near} where distance < 0.15 union all select b, a from {_near} where distance < 0.15),
walk(node, reach) as (select distinct p_name, p_name from part union select w.node, e.b from walk w join e on e.a = w.reach)
select node, min(reach) as component from walk group by 1)"""


def _resolved(spark, sf_dir):
    from ..sources import scratch

    names = B.table(spark, sf_dir, "part").select(F.col("p_name").alias("node")).distinct()
    values = scratch.stored(V.attach_vectors(names, None, "node").select("node", F.col("vector").alias("v")), "vectors")
    links = V.match_within(values.select(F.lit("part").alias("role"), F.col("node").alias("id"), "v"), "role", 0.15)
    return values, scratch.stored(R.connected_components(links, names), "components")


@query(f"select c.component, arg_max(p.p_name, (p.n, -p.rk)) as canonical_name, count(*) as aliases from {_comp} c join (select p_name, count(*) as n, row_number() over (order by p_name) as rk from part group by 1) p on p.p_name = c.node group by 1")
def resolve_entities(spark, sf_dir):
    """Part names, matched by their hash vectors, connected, and named by the most frequent value."""
    _, comp = _resolved(spark, sf_dir)
    counts = B.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("node")).agg(F.count("*").alias("n"))
    members = comp.join(counts, "node").select("component", F.col("node").alias("value"), "n")
    return R.canonical_names(members).join(members.groupBy("component").agg(F.count("*").alias("aliases")), "component")


@query(f"""select s.component, s.size, round(case when coalesce(d.known, 0) < s.size * (s.size - 1) / 2 then 0.0 else least(1.0, greatest(0.0, 1 - coalesce(d.far, 0.0))) end, 6) as confidence
from (select component, count(*) as size from {_comp} group by 1) s left join (select ca.component, max(n.distance) as far, count(*) as known from {_near} n join {_comp} ca on ca.node = n.a join {_comp} cb on cb.node = n.b where ca.component = cb.component group by 1) d on d.component = s.component""")
def cluster_confidence(spark, sf_dir):
    """E6."""
    values, comp = _resolved(spark, sf_dir)
    out = R.cluster_confidence(comp, values)
    return out.withColumn("confidence", F.round("confidence", 6))


@query(f"""with recursive p as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where {_cos.format('a.embedding', 'b.embedding')} < 0.7),
e as (select a, b from p union all select b, a from p), walk(node, reach) as (select vec_id, vec_id from embeddings union select w.node, e.b from walk w join e on e.a = w.reach)
select node, min(reach) as component from walk group by 1""")
def match_within_role(spark, sf_dir):
    """Vectors of one label within 0.7 of each other, connected."""
    e = B.table(spark, sf_dir, "embeddings")
    links = V.match_within(e.select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "label", 0.7)
    return R.connected_components(links, e.select("vec_id"))


@query(f"select role, lower(value) as norm, min(value) as representative, cast(sum(n) as bigint) as n from {_values} group by 1, 2")
def normalise_group(spark, sf_dir):
    """E1, E2."""
    values = V.distinct_values(_cells_of_roles(spark, sf_dir), None)
    return R.normalised_groups(R.entity_rows(values, B.role_table(spark)))


@query(f"select dataset, count(*) as n_values from {_values} group by 1")
def dataset_nodes(spark, sf_dir):
    """Tables with a value that has a vector."""
    values = V.distinct_values(_cells_of_roles(spark, sf_dir), None)
    return R.dataset_nodes(B.headers(spark, sf_dir).select("dataset").distinct(), values).join(values.groupBy("dataset").agg(F.count("*").alias("n_values")), "dataset")


@query("select count(*) as total, count(*) filter (e.vec_id is null) as weak, cast(count(*) filter (e.vec_id is null) as double) / count(*) as weak_share, case when count(*) = count(*) filter (e.vec_id is null) then 'all vectors are hashes' when count(*) filter (e.vec_id is null) > 0 then 'some vectors are hashes' end as warning from documents d left join embeddings e on e.vec_id = d.doc_id")
def vector_source_stats(spark, sf_dir):
    """E9."""
    given = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return R.vector_source_stats(V.attach_vectors(B.table(spark, sf_dir, "documents").select("doc_id"), given, "doc_id"))


_all_values = "(select distinct dataset, column_name, role, value from " + _values + ")"


@query(f"""with h as {_hash.format(col="value", table=_all_values)}, t as (select key, count(*) as filled, round(sum(w), 6) as total from h group by 1),
old as (select dataset, column_name, value from {_all_values} where length(value) % 2 = 0 union all select 'part', 'name', 'a value that went')
select coalesce(v.dataset, o.dataset) as dataset, coalesce(v.column_name, o.column_name) as column_name, coalesce(v.value, o.value) as value, case when v.value is null then 'given' else 'hash' end as embedding_source, case when v.value is null then 1.0 else t.total end as total
from {_all_values} v full join old o on o.dataset = v.dataset and o.column_name = v.column_name and o.value = v.value left join t on t.key = v.value""")
def embedded_values(spark, sf_dir):
    """V4: a vector for every value of every column with a role, written over the vectors that there were; one of a value that went stays."""
    values = V.distinct_values(_cells_of_roles(spark, sf_dir), None).select("dataset", "column_name", "value")
    old = values.filter(F.length("value") % 2 == 0).union(spark.createDataFrame([("part", "name", "a value that went")], "dataset string, column_name string, value string"))
    old = old.withColumns({"vector": F.array(F.lit(1.0)), "embedding_source": F.lit("given")})
    total = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6)
    return R.embed_entities(old, values).select("dataset", "column_name", "value", "embedding_source", total.alias("total"))


@query(f"select v.dataset, v.column_name, v.value, v.role, coalesce(lower(c.component), lower(v.value)) as component from {_all_values} v left join {_comp} c on v.role = 'service' and lower(trim(c.node)) = lower(v.value)")
def value_to_entity(spark, sf_dir):
    """Every raw value's entity: part names by their clusters, other values by their normal form."""
    _, comp = _resolved(spark, sf_dir)
    rows = R.entity_rows(V.distinct_values(_cells_of_roles(spark, sf_dir), None), B.role_table(spark))
    names = comp.select(F.lit("service").alias("role"), text.normalised(F.col("node")).alias("norm"), text.normalised(F.col("component")).alias("component")).distinct()
    others = rows.filter("role <> 'service'").select("role", text.normalised(F.col("value")).alias("norm")).distinct().withColumn("component", F.col("norm"))
    return R.aliases(rows, names.unionByName(others))


# --- keys -----------------------------------------------------------------------------------------------------

_norm = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_sim = f"case when {_norm('a.column_name')} = {_norm('b.column_name')} then 1.0 when contains({_norm('a.column_name')}, {_norm('b.column_name')}) or contains({_norm('b.column_name')}, {_norm('a.column_name')}) then 0.65 else 0.0 end"
_overlap = f"""(with cells as ({B.sql_cells()}), p as (select dataset, column_name, row_count, inferred_type from ({B.sql_profile()}) where not regexp_matches(column_name, '_id$')),
sets as (select distinct dataset, column_name, trim(value) as value from cells where trim(value) <> ''), sizes as (select dataset, column_name, count(*) as size from sets group by all),
pairs as (select a.dataset as a_dataset, a.column_name as a_column_name, b.dataset as b_dataset, b.column_name as b_column_name, a.row_count as ra, b.row_count as rb, a.inferred_type as ta, b.inferred_type as tb, cast({_sim} as double) as name_sim from p a join p b on a.dataset < b.dataset where {_sim} > 0),
shared as (select a_dataset, a_column_name, b_dataset, b_column_name, count(*) as shared from pairs join sets x on x.dataset = a_dataset and x.column_name = a_column_name join sets y on y.dataset = b_dataset and y.column_name = b_column_name and y.value = x.value group by all)
select p.a_dataset, p.a_column_name, p.b_dataset, p.b_column_name, name_sim, coalesce(s.shared, 0) as shared, cast(coalesce(s.shared, 0) as double) / least(x.size, y.size) as overlap, cast(x.size as double) / ra as uniq_a, cast(y.size as double) / rb as uniq_b, cast(case when ta = tb and ta <> 'unknown' then 1.0 else 0.5 end as double) as type_match
from pairs p left join shared s on s.a_dataset = p.a_dataset and s.a_column_name = p.a_column_name and s.b_dataset = p.b_dataset and s.b_column_name = p.b_column_name
join sizes x on x.dataset = p.a_dataset and x.column_name = p.a_column_name join sizes y on y.dataset = p.b_dataset and y.column_name = p.b_column_name)"""
_decided = f"""(select *, uniq_a >= uniq_b as pk_is_a, case when uniq_a >= uniq_b then uniq_a else uniq_b end as uniq,
least(cast(0.98 as double), cast(0.45 as double) * overlap + cast(0.3 as double) * uniq + cast(0.15 as double) * name_sim + cast(0.1 as double) * type_match) as conf from {_overlap})"""


def _overlaps(spark, sf_dir, min_overlap=0.0, min_uniqueness=0.0):
    profile = P.column_types(B.star(spark, sf_dir)).withColumn("is_technical", F.col("column_name").rlike("_id$"))
    return G.column_overlap(B.star(spark, sf_dir), profile, min_overlap, min_uniqueness)


@query(f"select a_dataset, a_column_name, b_dataset, b_column_name, name_sim, shared, overlap, uniq_a, uniq_b, type_match from {_overlap}")
def column_overlap(spark, sf_dir):
    """G1, G2."""
    return _overlaps(spark, sf_dir).select("a_dataset", "a_column_name", "b_dataset", "b_column_name", "name_sim", "shared", "overlap", "uniq_a", "uniq_b", "type_match")


@query(f"select a_dataset, a_column_name, b_dataset, b_column_name, overlap >= 0.6 and uniq >= 0.9 as is_match, pk_is_a from {_decided}")
def key_decision(spark, sf_dir):
    """G3."""
    c = F.col
    is_match, pk_is_a, _ = G.key_decision(c("overlap"), c("uniq_a"), c("uniq_b"), c("name_sim"), c("type_match"))
    found = _overlaps(spark, sf_dir, 0.6, 0.9)
    return found.select("a_dataset", "a_column_name", "b_dataset", "b_column_name", F.coalesce(is_match, F.lit(False)).alias("is_match"), pk_is_a.alias("pk_is_a"))


@query(f"""select from_dataset, to_dataset, label, weight, round(conf, 3) as confidence from (select *, row_number() over (partition by from_dataset, to_dataset order by round(conf, 3) desc, weight desc, label) as rn from
(select case when pk_is_a then b_dataset else a_dataset end as from_dataset, case when pk_is_a then a_dataset else b_dataset end as to_dataset, case when pk_is_a then b_column_name else a_column_name end as label, shared as weight, conf from {_decided} where overlap >= 0.6 and uniq >= 0.9)) where rn = 1""")
def discover_foreign_keys(spark, sf_dir):
    """Foreign keys between all star tables."""
    return G.discover_foreign_keys(_overlaps(spark, sf_dir, 0.6, 0.9))


# --- the sales graph ------------------------------------------------------------------------------------------

SALES = {"s_name": "vendor", "p_brand": "application", "p_type": "cloud_resource", "c_mktsegment": "cost_center", "o_orderpriority": "project"}
_from = "lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey"
_ent = lambda c: f"'{SALES[c]}:' || lower(trim({c}))"
_wide = f"(select {', '.join(f'{_ent(c)} as {c}' for c in SALES)} from {_from})"
_contain = "(" + " union all ".join(f"select 'sales' as dataset, '{c}' as column_name, {c} as entity, count(*) as weight from {_wide} group by 3" for c in SALES) + ")"


def sales(spark, sf_dir):
    """One row per line item: the values that meet in it.

    Each dimension's keys are dealt out and hashed part by part: no table is sorted, and no task holds a dimension whole. Suppliers come last, so that a task's rows share their vendors.
    """
    t = lambda n, *c: B.table(spark, sf_dir, n).select(*c)
    hashed = lambda df: df.hint("shuffle_hash")
    orders = t("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority").join(hashed(t("customer", F.col("c_custkey").alias("o_custkey"), "c_mktsegment")), "o_custkey")
    out = t("lineitem", "l_orderkey", "l_suppkey", "l_partkey").join(hashed(orders.select("l_orderkey", "c_mktsegment", "o_orderpriority")), "l_orderkey")
    out = out.join(hashed(t("part", F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")), "l_partkey").join(hashed(t("supplier", F.col("s_suppkey").alias("l_suppkey"), "s_name")), "l_suppkey")
    return out.select(*SALES)


def _entity(role, value):
    return F.concat(F.lit(role + ":"), text.normalised(value))


def _pairs(spark, sf_dir):
    """Counted pairs of values that meet in a line item: all that the graph takes from the sales table, in one pass."""
    from ..sources import scratch

    return scratch.stored(G.pair_counts(sales(spark, sf_dir), list(SALES)), "pairs")


def _containment(spark, sf_dir, pairs=None):
    """Values of the sales table counted per column first, then linked to entities. Pairs tell the counts, too: each row has one pair of a column with its neighbour."""
    from itertools import combinations

    from ..sources import scratch
    from ..sources.tables import cells

    if pairs is None:
        rows = cells(sales(spark, sf_dir), "sales", rename=str).groupBy("dataset", "column_name", "value").agg(F.count("*").alias("n"))
    else:
        place = {xy: k for k, xy in enumerate(combinations(SALES, 2))}
        of = {c: next((k, "u" if xy[0] == c else "v") for xy, k in place.items() if c in xy) for c in SALES}
        one = F.array_compact(F.array(*[F.when(F.col("pair") == k, F.struct(F.lit(c).alias("column_name"), F.col(side).alias("value"))) for c, (k, side) in of.items()]))
        rows = pairs.select("n", F.inline(one)).groupBy("column_name", "value").agg(F.sum("n").alias("n")).select(F.lit("sales").alias("dataset"), "column_name", "value", "n")
    rows = scratch.stored(rows, "values")
    values = rows.select("dataset", "column_name", "value")
    role = F.create_map(*[F.lit(x) for kv in SALES.items() for x in kv])[F.col("column_name")]
    aliases = values.withColumn("entity", F.concat(role, F.lit(":"), text.normalised(F.col("value"))))
    return G.containment_edges(rows, aliases.withColumn("value", text.trimmed(F.col("value"))).distinct())


@query(f"select dataset, column_name, entity, weight, cast(0.9 as double) as confidence from {_contain}")
def containment_edges(spark, sf_dir):
    """G5."""
    return _containment(spark, sf_dir)


_role_rows = B.sql_values(SALES.items())


@query(f"select c.dataset, c.column_name, 'HAS_' || upper(r.role) as label, 1 as weight, cast(0.9 as double) as confidence from (select distinct dataset, column_name from {_contain}) c join ({_role_rows}) as r(column_name, role) on r.column_name = c.column_name")
def attribute_groups(spark, sf_dir):
    """G6."""
    cols = spark.createDataFrame([("sales", c, r) for c, r in SALES.items()], "dataset string, column_name string, role string")
    return G.attribute_groups(_containment(spark, sf_dir), cols)


@query(f"select c.dataset, c.column_name, 'HAS_' || case when r.role is null then 'VALUE' else upper(r.role) end as label, n.row_count from {B.sql_columns()} c left join {B.sql_roles()} r on r.dataset = c.dataset and r.column_name = c.column_name join ({B.sql_counts()}) n on n.dataset = c.dataset")
def edge_label(spark, sf_dir):
    """The label of an edge to each column."""
    cols = B.headers(spark, sf_dir).join(F.broadcast(B.role_table(spark)), ["dataset", "column_name"], "left")
    return cols.join(B.row_counts(spark, sf_dir), "dataset").select("dataset", "column_name", text.edge_label(F.col("column_name"), F.col("role")).alias("label"), "row_count")


_labels = {(a, b): label for a, b, label in rules.PAIR_LABELS}


def _pair_sql() -> str:
    cols, parts = list(SALES), []
    for i, x in enumerate(cols):
        for y in cols[i + 1 :]:
            a, b = (y, x) if (SALES[y], SALES[x]) in _labels else (x, y)
            label = _labels.get((SALES[a], SALES[b]))
            ends = (a, b) if label else (f"least({a}, {b})", f"greatest({a}, {b})")
            parts.append(f"select {ends[0]} as from_id, {ends[1]} as to_id, '{label or 'co_occurs_with'}' as edge_type from {_wide}")
    return " union all ".join(parts)


_cooc = f"(select from_id, to_id, edge_type, count(*) as weight, least(cast(0.4 as double) + cast(0.1 as double) * count(*), cast(0.95 as double)) as confidence from ({_pair_sql()}) where from_id <> to_id group by all)"


@query(f"select * from {_cooc}")
def cooccurrence_edges(spark, sf_dir):
    """G8."""
    return G.cooccurrence_edges(sales(spark, sf_dir), SALES, entity=_entity)


@query("select l_suppkey as id_value, arg_max(l_returnflag, l_orderkey * 100 + l_linenumber) as entity from lineitem group by 1")
def id_property_aliases(spark, sf_dir):
    """The value that stands beside an ID in the last row that has it."""
    li = B.table(spark, sf_dir, "lineitem")
    return G.id_property_aliases(li.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_no"), F.col("l_suppkey").alias("id_value"), F.col("l_returnflag").alias("entity")))


@query(f"select dataset, row_count, 'could not re-read ' || dataset as warning from ({B.sql_counts()}) where dataset not in ('orders', 'customer')")
def skipped_datasets(spark, sf_dir):
    """Tables of the catalogue that a run which loaded two of them has left out."""
    return G.skipped_datasets(B.row_counts(spark, sf_dir), B.cells(spark, sf_dir, ("orders", "customer")).select("dataset"))


_nodes = f"(select distinct e as id, e as name, split_part(e, ':', 1) as entity_type from (select from_id as e from {_cooc} union all select to_id from {_cooc}))"


def _graph(spark, sf_dir, pairs=None):
    from ..sources import scratch

    edges = scratch.stored(G.edges_of_pairs(_pairs(spark, sf_dir) if pairs is None else pairs, SALES, entity=_entity), "edges")
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    return ids.select("id", F.col("id").alias("name"), F.substring_index("id", ":", 1).alias("entity_type")), edges


@query(f"select e.from_id, e.to_id, e.edge_type, e.weight, a.name as from_name, b.entity_type as to_type, k.alias_count from {_cooc} e join {_nodes} a on a.id = e.from_id join {_nodes} b on b.id = e.to_id join (select entity, count(*) as alias_count from {_contain} group by 1) k on k.entity = e.from_id")
def graph_view(spark, sf_dir):
    """Edges with what stands at their ends."""
    pairs = _pairs(spark, sf_dir)
    nodes, edges = _graph(spark, sf_dir, pairs)
    n, e = G.graph_view(nodes, edges, _containment(spark, sf_dir, pairs).select(F.col("entity").alias("id")))
    return e.join(n.select(F.col("id").alias("from_id"), "alias_count"), "from_id").select("from_id", "to_id", "edge_type", "weight", "from_name", "to_type", "alias_count")


@query(f"select entity as id, dataset, column_name, weight from {_contain} where entity = 'cost_center:building'")
def entity_aliases(spark, sf_dir):
    """Where one entity's values stand."""
    return G.entity_aliases(_containment(spark, sf_dir).select(F.col("entity").alias("id"), "dataset", "column_name", "weight", F.col("entity").alias("value")), "cost_center:building").select("id", "dataset", "column_name", "weight")


_supply = "(select distinct 's' || l_suppkey as from_id, 'p' || l_partkey as to_id from lineitem)"
_walk = """with recursive e as (select from_id as a, to_id as b from {edges} union select to_id, from_id from {edges}),
walk(id, depth) as (select '{seed}', 0 union select e.b, w.depth + 1 from walk w join e on e.a = w.id where w.depth < {depth})
select id, min(depth) as depth from walk group by 1"""


def _supplies(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("to_id")).distinct()


@query(_walk.format(edges=_supply, seed="s1", depth=6))
def trace(spark, sf_dir):
    """What a supplier reaches over supplier-part edges in six steps."""
    seed = spark.createDataFrame([("s1",)], "id string")
    return G.trace(_supplies(spark, sf_dir), seed)


@query(_walk.format(edges=_supply, seed="s2", depth=2))
def neighbourhood(spark, sf_dir):
    """Two steps around a node."""
    return G.trace(_supplies(spark, sf_dir), spark.createDataFrame([("s2",)], "id string"), 2)


_domain = "case " + " ".join(f"when regexp_matches(lower({{c}}), '{p}') then '{v}'" for p, v in rules.DOMAINS) + " else 'General Domain' end"


@query(f"select {_domain.format(c='url')} as domain, count(*) as n from pages group by 1")
def derive_domain(spark, sf_dir):
    """Business domains by name, over the pages' addresses."""
    return B.table(spark, sf_dir, "pages").groupBy(text.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"select from_id, to_id, edge_type from {_cooc} where split_part(from_id, ':', 1) not in ('vendor') and split_part(to_id, ':', 1) not in ('vendor')")
def induced_subgraph(spark, sf_dir):
    """The graph without its vendors."""
    nodes, edges = _graph(spark, sf_dir)
    return G.without_types(nodes, edges, ("vendor",))[1].select("from_id", "to_id", "edge_type")


@query(f"select 'nodes' as metric, count(*) as n from {_nodes} union all select 'edges', count(*) from {_cooc} union all select 'aliases', count(*) from {_contain}")
def graph_build_stats(spark, sf_dir):
    """G17."""
    pairs = _pairs(spark, sf_dir)
    nodes, edges = _graph(spark, sf_dir, pairs)
    return G.build_stats(nodes, edges, _containment(spark, sf_dir, pairs))


# --- the graph of tables, their columns and the values in them ----------------------------------------------------

#: Where each column of the graph comes from: node name of its table, group, role, SQL of the values.
PLACES = (
    ("cloud_suppliers", "name", "vendor", "select s_name as v from supplier"),
    ("cloud_suppliers", "nation", "business_unit", "select n_name as v from supplier join nation on n_nationkey = s_nationkey"),
    ("app_parts", "brand", "application", "select p_brand as v from part"),
    ("customer_accounts", "segment", "cost_center", "select c_mktsegment as v from customer"),
    ("customer_accounts", "nation", "business_unit", "select n_name as v from customer join nation on n_nationkey = c_nationkey"),
    ("cost_orders", "priority", "project", "select o_orderpriority as v from orders"),
)
LINKS = (("cost_orders", "customer_accounts"), ("shipped_items", "cost_orders"), ("shipped_items", "app_parts"), ("shipped_items", "cloud_suppliers"))
_held = " union all ".join(f"select distinct '{d}' as dataset, '{c}' as column_name, '{r}' as role, '{r}:' || lower(trim(v)) as entity from ({q}) where trim(v) <> ''" for d, c, r, q in PLACES)
_tables = sorted({d for d, *_ in PLACES} | {x for link in LINKS for x in link})
_tree_edges = f"""(select 'd:' || dataset as from_id, 'g:' || dataset || '.' || column_name as to_id, 'has_attribute' as edge_type from ({_held}) group by all union all select 'g:' || dataset || '.' || column_name, entity, 'contains_reference' from ({_held})
union all select * from ({B.sql_values([(f"d:{a}", f"d:{b}", "foreign_key") for a, b in LINKS])}) as l(from_id, to_id, edge_type) union all select from_id, to_id, 'co_occurs_with' from (select distinct 'cost_center:' || lower(trim(c_mktsegment)) as from_id, 'project:' || lower(trim(o_orderpriority)) as to_id from orders join customer on c_custkey = o_custkey))"""
_tree_nodes = f"(select * from ({B.sql_values([(f'd:{d}', d, 'dataset') for d in _tables])}) as t(id, name, entity_type) union all select distinct 'g:' || dataset || '.' || column_name, column_name, 'attribute_group' from ({_held}) union all select distinct entity, entity, role from ({_held}))"


def _tree(spark, sf_dir):
    """(nodes, edges): tables, their columns as groups, the values in them, foreign keys, and which segments meet which priorities."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from ..sources import scratch

    t = lambda n: B.table(spark, sf_dir, n)
    nation = F.broadcast(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")))
    values = {
        ("cloud_suppliers", "name"): t("supplier").select(F.col("s_name").alias("v")), ("cloud_suppliers", "nation"): t("supplier").select(F.col("s_nationkey").alias("k")).join(nation, "k").select("v"),
        ("app_parts", "brand"): t("part").select(F.col("p_brand").alias("v")), ("customer_accounts", "segment"): t("customer").select(F.col("c_mktsegment").alias("v")),
        ("customer_accounts", "nation"): t("customer").select(F.col("c_nationkey").alias("k")).join(nation, "k").select("v"), ("cost_orders", "priority"): t("orders").select(F.col("o_orderpriority").alias("v")),
    }
    held = [values[d, c].filter(text.trimmed(F.col("v")) != "").select(F.lit(d).alias("dataset"), F.lit(c).alias("column_name"), F.lit(r).alias("role"), F.concat(F.lit(r + ":"), text.normalised(F.col("v"))).alias("entity")).distinct() for d, c, r, _ in PLACES]
    held = scratch.stored(reduce(DataFrame.union, held), "held")
    group = F.concat(F.lit("g:"), "dataset", F.lit("."), "column_name")
    owns = held.select(F.concat(F.lit("d:"), "dataset").alias("from_id"), group.alias("to_id"), F.lit("has_attribute").alias("edge_type")).distinct()
    holds = held.select(group.alias("from_id"), F.col("entity").alias("to_id"), F.lit("contains_reference").alias("edge_type"))
    links = spark.createDataFrame([(f"d:{a}", f"d:{b}", "foreign_key") for a, b in LINKS], "from_id string, to_id string, edge_type string")
    meet = t("orders").select("o_custkey", "o_orderpriority").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    meet = meet.select(F.concat(F.lit("cost_center:"), text.normalised(F.col("c_mktsegment"))).alias("from_id"), F.concat(F.lit("project:"), text.normalised(F.col("o_orderpriority"))).alias("to_id"), F.lit("co_occurs_with").alias("edge_type")).distinct()
    nodes = spark.createDataFrame([(f"d:{d}", d, "dataset") for d in _tables], "id string, name string, entity_type string")
    nodes = nodes.union(held.select(group.alias("id"), F.col("column_name").alias("name"), F.lit("attribute_group").alias("entity_type")).distinct()).union(held.select(F.col("entity").alias("id"), F.col("entity").alias("name"), F.col("role").alias("entity_type")).distinct())
    return scratch.stored(nodes, "nodes"), scratch.stored(owns.union(holds).union(links).union(meet), "edges")


_around = f"""(with recursive s as (select id from {_tree_nodes} where entity_type = 'dataset' and {_domain.format(c="name")} = 'Finance Domain'), e as (select from_id as a, to_id as b from {_tree_edges} where edge_type <> 'co_occurs_with' union select to_id, from_id from {_tree_edges} where edge_type <> 'co_occurs_with'),
walk(seed, id, depth) as (select id, id, 0 from s union select w.seed, e.b, w.depth + 1 from walk w join e on e.a = w.id where w.depth < 2) select seed, id, min(depth) as depth from walk group by 1, 2)"""


@query(f"select * from {_around}")
def domain_neighbourhood(spark, sf_dir):
    """Which table of the finance domain reaches what in two steps, without walking over co-occurrence."""
    nodes, edges = _tree(spark, sf_dir)
    return G.neighbourhood(edges, G.domain_seeds(nodes, "Finance Domain"))[0]


@query(f"select from_id, to_id, edge_type from {_tree_edges} where from_id in (select id from {_around}) and to_id in (select id from {_around})")
def neighbourhood_edges(spark, sf_dir):
    """The edges between what the finance domain reaches, co-occurrence among them."""
    nodes, edges = _tree(spark, sf_dir)
    return G.neighbourhood(edges, G.domain_seeds(nodes, "Finance Domain"))[1].select("from_id", "to_id", "edge_type")


_shut = "select to_id as child, count(*) as n, count(*) filter (from_id = 'g:customer_accounts.nation') as shut from {e} where edge_type = 'contains_reference' group by 1"


@query(f"""with c as ({_shut.format(e=_tree_edges)}), a as (select id from {_tree_nodes} where id not in (select child from c where shut > 0)), x as (select id from {_tree_nodes} where id not in (select child from c where shut = n))
select from_id, to_id, edge_type, from_id in (select id from a) and to_id in (select id from a) as stays_plain from {_tree_edges} where from_id in (select id from x) and to_id in (select id from x)""")
def collapsed_groups(spark, sf_dir):
    """The edges left when the customers' nations are collapsed: nations that suppliers have too stay, unless any collapsed parent hides a child."""
    nodes, edges = _tree(spark, sf_dir)
    groups = spark.createDataFrame([("g:customer_accounts.nation",)], "id string")
    plain = G.collapsed(nodes, edges, groups)[1].select("from_id", "to_id", "edge_type", F.lit(True).alias("kept"))
    left = G.collapsed(nodes, edges, groups, exclusive=True)[1].select("from_id", "to_id", "edge_type")
    return left.join(plain, ["from_id", "to_id", "edge_type"], "left").select("from_id", "to_id", "edge_type", F.coalesce("kept", F.lit(False)).alias("stays_plain"))
