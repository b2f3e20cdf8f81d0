"""Queries on sources, profiles and column meaning (S, P, C), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import columns as C
from ..operators import profile as P
from ..sources import runs, scratch, versions
from ..sources import tables as S
from . import base as B

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _when(col: str, patterns, otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({col}), '{p}') then '{v}'" for p, v in patterns) + f" else {otherwise} end"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"select dataset, column_name, count(*) as cells, count(value) as filled from ({B.sql_cells()}) group by all")
def read_rows(spark, sf_dir):
    """Every table as cells; how many each column has."""
    return B.cells(spark, sf_dir).groupBy("dataset", "column_name").agg(F.count("*").alias("cells"), F.count("value").alias("filled"))


@query(f"select dataset, row_count, row_number() over (order by row_count desc, dataset) as position from ({B.sql_counts()})")
def list_datasets(spark, sf_dir):
    """The catalogue, largest first."""
    from pyspark.sql import Window

    return B.row_counts(spark, sf_dir).withColumn("position", F.row_number().over(Window.orderBy(F.desc("row_count"), "dataset")).cast("long"))


@query("select user_id, event_type as status, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def current_status(spark, sf_dir):
    """The state that an append-only log of events leaves each key in."""
    return S.latest_state(B.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"), "event_id")


@query("""select coalesce(c.c_custkey, o.k) as c_custkey, c.c_name, case when o.k is not null then o.p else c.c_mktsegment end as c_mktsegment, coalesce(c.c_acctbal, 0) + coalesce(o.n, 0) as c_acctbal
from customer c full join (select o_custkey as k, max(o_orderpriority) as p, count(*) as n from orders group by 1) o on o.k = c.c_custkey""")
def upsert(spark, sf_dir):
    """Customers, overwritten from their orders; one column keeps a combination of old and new."""
    old = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"), F.count("*").cast("double").alias("c_acctbal"))
    combined = F.coalesce("old.c_acctbal", F.lit(0.0)) + F.coalesce("new.c_acctbal", F.lit(0.0))
    return S.upsert(old, new, ["c_custkey"], {"c_acctbal": combined})


@query("select l_suppkey as from_id, l_partkey as to_id, 'supplies' as edge_type, count(*) as weight, max(l_discount) as confidence, arg_max(l_returnflag, l_orderkey * 100 + l_linenumber) as label from lineitem group by 1, 2")
def merge_edges(spark, sf_dir):
    """Supplier-part edges from line items: weights add, the highest confidence and the last label stay."""
    items = B.table(spark, sf_dir, "lineitem")
    edges = items.select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("supplies").alias("edge_type"), F.lit(1).cast("long").alias("weight"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return S.merge_edges(edges)


@query("select sha256(concat_ws('|', cast(o_custkey as varchar), cast(o_orderkey as varchar))) as id, o_custkey as from_id, o_orderkey as to_id from orders where o_custkey <> o_orderkey and o_custkey in (select c_custkey from customer)")
def replace_table(spark, sf_dir):
    """Edges whose ends exist and differ, with ids that a rebuild gives again."""
    orders = B.table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id"))
    nodes = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(orders.select("o_orderkey"))
    own = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("from_id"))
    return S.valid_edges(edges, nodes).join(own, "from_id", "left_semi").select(S.stable_id(F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id")


@query(f"select dataset, 'ok' as status, row_count from ({B.sql_counts()}) union all select 'no_such_table', 'failed', null")
def ingest_batch(spark, sf_dir):
    """All star tables as runs of their own, several at once, and one that isn't there."""
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    paths = [f"{sf_dir}/{n}.parquet" for n in (*B.STAR, "no_such_table")]
    _, log = S.ingest_batch(spark, paths, lambda path, df: S.cells(df, name(path)).filter("ordinal = 0"))
    return log.select(F.substring_index(F.substring_index("name", "/", -1), ".", 1).alias("dataset"), "status", "row_count")


@query("select cast(2 as integer) as version, sha256(concat_ws('|', cast(o_custkey as varchar), cast(o_orderkey as varchar))) as id, o_custkey as from_id, o_orderkey as to_id from orders where o_custkey <> o_orderkey and o_custkey in (select c_custkey from customer)")
def graph_versions(spark, sf_dir):
    """A graph written as it comes, replaced as a whole by one whose edges have both ends, and read through its manifest."""
    orders = B.table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id"))
    customers = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    base = scratch.path(spark, "graph")
    first = versions.replace_tables({"nodes": customers, "edges": edges}, base)
    last = versions.read_tables(spark, base)
    sound = last["edges"].filter("from_id <> to_id").join(last["nodes"].withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    second = versions.replace_tables({"nodes": last["nodes"], "edges": sound.select(S.stable_id(F.col("from_id"), F.col("to_id")).alias("id"), "from_id", "to_id")}, base, expected=first)
    return versions.read_tables(spark, base)["edges"].withColumn("version", F.lit(second))


@query("""with e as (select user_id, event_id, ts, event_type, event_type = 'signup' as s, event_type in ('purchase', 'error') as f from events),
n as (select *, sum(case when s then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run_no from e where s or f),
r as (select user_id, run_no, min(epoch_us(ts)) filter (s) as started_us, arg_max(epoch_us(ts), (ts, event_id)) filter (f) as finished_us, arg_max(event_type, (ts, event_id)) filter (f) as last, count(*) filter (f) as finish_count from n where run_no > 0 group by all)
select user_id, cast(run_no as bigint) as run_no, started_us, finished_us, case when finish_count > 0 then last when run_no < max(run_no) over (partition by user_id) then 'abandoned' else 'running' end as status, finish_count, (finished_us - started_us) / 1000000 as seconds from r""")
def run_log(spark, sf_dir):
    """The runs that the event log tells of: a signup starts one, purchases and errors finish it."""
    kind = F.col("event_type")
    out = runs.intervals(B.table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], kind == "signup", kind.isin("purchase", "error"), kind)
    return out.select("user_id", "run_no", F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("finished").cast("timestamp")).alias("finished_us"), "status", "finish_count", "seconds")


_TAXONOMY = """select distinct 'resource_tower' as layer, trim(p_type) as level_1, trim(p_brand) as level_2, p_size > 45 as is_retired,
concat_ws(' > ', trim(p_type), trim(p_brand)) as path, concat_ws('. ', trim(p_type), trim(p_brand), 'size ' || p_size) as search_text from part where trim(p_type) <> '' and trim(p_brand) <> ''"""


def _taxonomy(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    items = part.select(F.col("p_type").alias("level_1"), F.col("p_brand").alias("level_2"), F.lit(None).cast("string").alias("level_3"), F.concat(F.lit("size "), F.col("p_size")).alias("description"), F.when(F.col("p_size") > 45, "yes").otherwise("no").alias("retired"))
    return S.load_taxonomy(items.distinct(), "resource_tower")


@query(_TAXONOMY)
def load_taxonomy(spark, sf_dir):
    """Part types and brands as a two-level tree."""
    return _taxonomy(spark, sf_dir).select("layer", "level_1", "level_2", "is_retired", "path", "search_text")


@query(f"select level_1, count(*) as items from ({_TAXONOMY}) where not is_retired and layer = 'resource_tower' group by 1")
def list_taxonomy(spark, sf_dir):
    """What is not retired, by layer."""
    return S.list_taxonomy(_taxonomy(spark, sf_dir), "resource_tower").groupBy("level_1").agg(F.count("*").alias("items"))


@query("select c_custkey as k, c_name as name, 'rows' as source_kind from customer where c_custkey in (select o_custkey from orders) union all select c_custkey, c_mktsegment, 'fallback' from customer where c_custkey not in (select o_custkey from orders)")
def fallback_source(spark, sf_dir):
    """Customers with orders by their rows, the others by what is known of them otherwise."""
    c = B.table(spark, sf_dir, "customer")
    primary = c.join(B.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return S.with_fallback(primary, c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name")), "k")


@query(B.sql_profile())
def profile_columns(spark, sf_dir):
    """The profile of every column of the star tables."""
    out = B.profile(spark, sf_dir)
    return out.select("dataset", "column_name", "ordinal", "row_count", "nulls", "distinct_count", "inferred_type", "is_key", F.array_join("samples", "|").alias("samples"))


@query(f"select dataset, column_name, inferred_type from ({B.sql_profile()})")
def infer_type(spark, sf_dir):
    """P2."""
    return B.profile(spark, sf_dir).select("dataset", "column_name", "inferred_type")


@query(f"select dataset, column_name, distinct_count from ({B.sql_profile()}) where is_key")
def candidate_keys(spark, sf_dir):
    """P3."""
    return B.profile(spark, sf_dir).filter("is_key").select("dataset", "column_name", "distinct_count")


_SOURCES = """with kw as (select * from ({kw}) as k(pref, source_type, keyword)),
hits as (select c.dataset, k.pref, k.source_type, count(distinct k.keyword) as score from {cols} c join kw k on contains(replace(lower(c.column_name), ' ', '_'), k.keyword) group by all),
best as (select * from (select *, row_number() over (partition by dataset order by score desc, pref) as n from hits) where n = 1)
select d.dataset, coalesce(b.source_type, 'Unknown') as source_type, case when b.dataset is null then 0.2 else least(cast(0.5 as double) + cast(0.15 as double) * b.score, cast(0.95 as double)) end as confidence
from (select distinct dataset from {cols}) d left join best b on b.dataset = d.dataset"""
_WORDS = {"ERP": ("partkey", "suppkey", "quantity"), "CMDB": ("event", "props"), "General Ledger": ("acctbal", "totalprice", "price"), "HR Systems": ("user_id", "nation")}
_sources_sql = _SOURCES.format(kw=B.sql_values([(i, s, k) for i, (s, ks) in enumerate(_WORDS.items()) for k in ks]), cols=B.sql_columns())


@query(f"select s.*, n.row_count from ({_sources_sql}) s join ({B.sql_counts()}) n on n.dataset = s.dataset")
def classify_source(spark, sf_dir):
    """P5: what kind of source each table is, by keywords that fit the driver's headers."""
    return P.classify_source(B.headers(spark, sf_dir), _WORDS).join(B.row_counts(spark, sf_dir), "dataset")


@query(f"select s.dataset, case when s.dataset = 'lineitem' then 'Invoices' else s.source_type end as source_type, case when s.dataset = 'lineitem' then 0.9 when s.dataset = 'region' then s.confidence * 0.8 else s.confidence end as confidence, n.row_count from ({_sources_sql}) s join ({B.sql_counts()}) n on n.dataset = s.dataset")
def source_verdicts(spark, sf_dir):
    """An outside verdict for one table, a failed one for another."""
    found = P.classify_source(B.headers(spark, sf_dir), _WORDS)
    verdicts = spark.createDataFrame([("lineitem", "Invoices", 0.9), ("region", None, None)], "dataset string, source_type string, confidence double")
    return P.apply_source_verdicts(found, verdicts).join(B.row_counts(spark, sf_dir), "dataset")


_profile = f"({B.sql_profile()})"
_uuid = "coalesce(list_bool_and(list_transform(string_split(samples, '|'), lambda v: regexp_matches(lower(v), '" + rules.UUID_VALUE + "'))), true)"
_classified = f"""(select *, regexp_matches(lower(column_name), '{rules.TECHNICAL_NAME}') or {_uuid} or regexp_matches(lower(column_name), '{rules.TIMESTAMP_NAME}') as is_technical,
case when is_technical then 'identifier' else {_when("column_name", rules.ROLE_PATTERNS, "'other'")} end as role,
case when is_technical then 0.9 when role = 'other' then 0.3 else 0.65 end as role_confidence from {_profile})"""


@query(f"select dataset, column_name, role, cast(role_confidence as double) as role_confidence, is_technical from {_classified}")
def classify_columns(spark, sf_dir):
    """Roles by name patterns and samples."""
    return C.classify_columns(B.profile(spark, sf_dir)).select("dataset", "column_name", "role", "role_confidence", "is_technical")


_OVER = {"cost_center": ("mktsegment",), "identifier": ("orderkey", "linenumber"), "vendor": ("suppkey",)}
_over = B.sql_values([(n, r) for r, ns in _OVER.items() for n in ns])


@query(f"""select c.dataset, c.column_name, coalesce(o.sure, c.role) as role, cast(case when o.sure is not null then 1.0 else c.role_confidence end as double) as role_confidence,
case when o.sure is not null then o.sure = 'identifier' else c.is_technical end as is_technical
from {_classified} c left join ({_over}) as o(norm, sure) on o.norm = regexp_replace(lower(c.column_name), '[\\s_-]', '', 'g')""")
def override_roles(spark, sf_dir):
    """Names that are certain, here from a table that fits the driver's headers."""
    return C.override_roles(C.classify_columns(B.profile(spark, sf_dir)), _OVER).select("dataset", "column_name", "role", "role_confidence", "is_technical")


@query(f"""select c.dataset, c.column_name, coalesce(v.role, c.role) as role, cast(case when v.role is not null then 0.5 else c.role_confidence end as double) as role_confidence
from {_classified} c left join (select dataset, column_name, case when role = 'project' then 'other' else role end as role from {B.sql_roles()}) v on v.dataset = c.dataset and v.column_name = c.column_name""")
def role_verdicts(spark, sf_dir):
    """The role table as an outside verdict, one of its roles unknown."""
    v = B.role_table(spark).withColumn("role", F.when(F.col("role") == "project", "no such role").otherwise(F.col("role")))
    v = v.withColumn("role_confidence", F.lit(None).cast("double")).withColumn("is_technical", F.lit(False))
    return C.apply_role_verdicts(C.classify_columns(B.profile(spark, sf_dir)), v).select("dataset", "column_name", "role", "role_confidence")


@query(f"select s.dataset, s.source_type || ' dataset with ' || n.n || ' columns' as business_purpose, t.row_count from ({_sources_sql}) s join (select dataset, count(distinct column_name) as n from {B.sql_columns()} group by 1) n on n.dataset = s.dataset join ({B.sql_counts()}) t on t.dataset = s.dataset")
def describe_purpose(spark, sf_dir):
    """C4."""
    cols = B.headers(spark, sf_dir)
    return C.describe_purpose(cols, P.classify_source(cols, _WORDS)).join(B.row_counts(spark, sf_dir), "dataset")


_norm = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_sim = lambda a, b: f"case when {_norm(a)} = '' or {_norm(b)} = '' then 0.0 when {_norm(a)} = {_norm(b)} then 1.0 when contains({_norm(a)}, {_norm(b)}) or contains({_norm(b)}, {_norm(a)}) then 0.65 else 0.0 end"


@query(f"with p as (select distinct p_name as name from part), b as (select distinct p_type as kind from part) select p.name, b.kind, cast({_sim('p.name', 'b.kind')} as double) as similarity from p, b")
def name_similarity_pairs(spark, sf_dir):
    """All part names against all part types (both bounded vocabularies)."""
    part = B.table(spark, sf_dir, "part")
    names, kinds = part.select(F.col("p_name").alias("name")).distinct(), part.select(F.col("p_type").alias("kind")).distinct()
    return names.join(kinds, F.lit(True)).withColumn("similarity", text.name_similarity(F.col("name"), F.col("kind")))


_lists = lambda c: f"list_distinct(list_transform(string_split({c}, '|'), lambda v: lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g'))))"
_overlap = lambda a, b: f"cast(len(list_intersect({_lists(a)}, {_lists(b)})) as double) / least(len({_lists(a)}), len({_lists(b)}))"


@query(f"select a.dataset as a, a.column_name as a_column, b.dataset as b, b.column_name as b_column, {_overlap('a.samples', 'b.samples')} as overlap from {_profile} a join {_profile} b on a.dataset < b.dataset where a.inferred_type = b.inferred_type")
def value_overlap(spark, sf_dir):
    """Shared samples of columns of one type in different tables (catalogue-sized)."""
    p = B.profile(spark, sf_dir).select("dataset", "column_name", "inferred_type", "samples")
    a, b = p.toDF("a", "a_column", "inferred_type", "sa"), p.toDF("b", "b_column", "inferred_type", "sb")
    return a.join(b, "inferred_type").filter("a < b").select("a", "a_column", "b", "b_column", text.value_overlap(F.col("sa"), F.col("sb")).alias("overlap"))


_known = f"(select p.*, case when r.role is null and regexp_matches(p.column_name, '(key|_id)$') then true else false end as is_technical, case when is_technical then 'identifier' else coalesce(r.role, 'other') end as role from {_profile} p left join {B.sql_roles()} r on r.dataset = p.dataset and r.column_name = p.column_name)"
_related = f"""(select from_dataset, from_column_name, to_dataset, to_column_name, case when overlap >= 0.5 then 'value_overlap' else 'name_similarity' end as relationship_type, confidence,
concat_ws('; ', case when name_sim > 0 then 'similar column names' end, case when overlap > 0 then 'overlapping values' end, case when same_role then 'same semantic role' end) as reasoning from
(select a.dataset as from_dataset, a.column_name as from_column_name, b.dataset as to_dataset, b.column_name as to_column_name, cast({_sim('a.column_name', 'b.column_name')} as double) as name_sim, {_overlap('a.samples', 'b.samples')} as overlap, a.role = b.role as same_role,
least(cast(0.5 as double) * name_sim + cast(0.4 as double) * overlap + case when same_role then cast(0.2 as double) else cast(0 as double) end, cast(0.98 as double)) as confidence
from (select * from {_known} where not is_technical and role not in {_in(rules.UNRELATABLE_ROLES)}) a, (select * from {_known} where not is_technical and role not in {_in(rules.UNRELATABLE_ROLES)}) b where a.dataset > b.dataset) where confidence >= 0.4)"""


def _roles(spark, sf_dir):
    return B.with_roles(B.profile(spark, sf_dir))


@query(f"select * from {_related}")
def detect_relationships(spark, sf_dir):
    """C7."""
    return C.detect_relationships(_roles(spark, sf_dir))


@query(f"select * from {_related} where from_dataset = 'supplier' or to_dataset = 'supplier'")
def list_relationships(spark, sf_dir):
    """C8."""
    return C.list_relationships(C.detect_relationships(_roles(spark, sf_dir)), "supplier")


@query(f"""select k.dataset, k.column_name, k.role from {_known} k where k.role <> 'identifier' and not (k.dataset = 'supplier' and k.column_name = 'suppkey')""")
def pair_id_columns(spark, sf_dir):
    """The columns left once an ID is a property of the name beside it (supplier key and supplier name)."""
    named = _roles(spark, sf_dir).withColumn("column_name", F.when(F.col("column_name") == "suppkey", "suppkey_id").otherwise(F.col("column_name")))
    rest, _ = C.pair_id_columns(named)
    return rest.filter("role <> 'identifier'").select("dataset", "column_name", "role")


@query(f"select dataset, column_name, role from {_known} where not is_technical and role in {_in(rules.EMBEDDABLE_ROLES)}")
def embeddable_columns(spark, sf_dir):
    """C12."""
    return C.embeddable_columns(_roles(spark, sf_dir)).select("dataset", "column_name", "role")


@query(f"select dataset, column_name, case when role = 'identifier' then 'other' else role end as role, is_technical or role = 'identifier' as is_technical from {_known}")
def columns_update(spark, sf_dir):
    """Identifiers become technical columns without a role."""
    known = _roles(spark, sf_dir).select("dataset", "column_name", "role", "is_technical")
    updates = known.filter("role = 'identifier'").select("dataset", "column_name", F.lit("other").alias("role"), F.lit(True).alias("is_technical"))
    return C.update_columns(known, updates)


_codes = "(select 'S-' || s_suppkey as code, s_name as name from supplier)"
_five = lambda c: f"(select {c} as v from {_codes} where trim({c}) <> '' group by 1 order by 1 limit 5)"
_coded = lambda c: f"(select count(*) filter (length(trim(v)) <= 10 and regexp_matches(trim(v), '^[A-Za-z]{{0,6}}[-_ ]?\\d+[A-Za-z0-9-]*$')) >= 0.6 * count(*) from {_five(c)})"


@query(f"select 'deals' as dataset, 'Supplier Name' as column_name, case when {_coded('code')} and not {_coded('name')} then 'Supplier' end as id_column")
def paired_codes(spark, sf_dir):
    """Two columns that both look like names; the one whose values are shaped like codes becomes the other's property."""
    deals = B.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S-"), F.col("s_suppkey")).alias("Supplier"), F.col("s_name").alias("Supplier Name"))
    columns = P.profile_tables({"deals": deals}, rename=str).withColumn("role", F.lit("vendor"))
    rest, pairs = C.pair_id_columns(columns)
    return rest.select("dataset", "column_name").join(pairs.select("dataset", F.col("name_column").alias("column_name"), "id_column"), ["dataset", "column_name"], "left")
