"""Queries on taxonomy mapping and the output model (M, A), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import model as A
from ..operators import taxonomy as M
from ..operators import vectors as V
from ..sources import scratch
from ..sources import tables as S
from . import base as B
from . import graphs, quality

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Rules in the driver's words: pattern of the context, pattern of the category's path, label.
RULES = ((r"\b(economy|small)\b", r"economy|small", "low-end goods"), (r"\b(large|medium)\b", r"large|medium", "mid-range goods"), (r"\b(promo|standard)\b", r"promo|standard", "listed goods"))
PART_ROLES = {"p_name": "service", "p_brand": "application", "p_type": "cloud_resource"}

_in = lambda vs: "(" + ", ".join(f"'{v}'" for v in vs) + ")"
_known = f"(select c.dataset, c.column_name, c.ordinal, coalesce(r.role, 'other') as role, n.row_count from {B.sql_columns()} c left join {B.sql_roles()} r on r.dataset = c.dataset and r.column_name = c.column_name join ({B.sql_counts()}) n on n.dataset = c.dataset)"


def _columns(spark, sf_dir):
    cols = B.headers(spark, sf_dir).join(F.broadcast(B.role_table(spark)), ["dataset", "column_name"], "left")
    return cols.withColumn("role", F.coalesce("role", F.lit("other"))).withColumn("is_technical", F.lit(False)).join(B.row_counts(spark, sf_dir), "dataset")


@query(f"select dataset, column_name, role, row_count from {_known} where role in {_in(rules.LAYER_ROLES['resource_tower'])} or regexp_matches(lower(column_name), '{rules.USEFUL_NAME}')")
def useful_columns(spark, sf_dir):
    """M1."""
    return M.useful_columns(_columns(spark, sf_dir), "resource_tower").select("dataset", "column_name", "role", "row_count")


@query("select dataset, column_name, case role " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(rules.ANCHOR_ORDER)) + f" else 100 end as anchor_rank, row_count from {_known}")
def anchor_rank(spark, sf_dir):
    """M2."""
    return _columns(spark, sf_dir).select("dataset", "column_name", M.anchor_rank(F.col("role")).alias("anchor_rank"), "row_count")


_ctx = "(select p_partkey as row_no, 'p_name' as anchor_column, trim(p_name) as anchor_value, 'Dataset type: Parts. p_name: ' || trim(p_name) || '. p_brand: ' || trim(p_brand) || '. p_type: ' || trim(p_type) as context_text from part)"


def _contexts(spark, sf_dir):
    return M.row_context(B.table(spark, sf_dir, "part"), PART_ROLES, F.col("p_partkey"), "Parts")


@query(f"select * from {_ctx}")
def row_context(spark, sf_dir):
    """M3: the context of every part."""
    return _contexts(spark, sf_dir).select("row_no", "anchor_column", "anchor_value", "context_text")


_dedup = f"(select anchor_column, lower(anchor_value) as anchor_key, arg_min(anchor_value, row_no) as anchor_value, arg_min(context_text, row_no) as context_text, count(*) as occurrences, min(row_no) as first_row from {_ctx} group by 1, 2)"


@query(f"select anchor_key, anchor_value, context_text, occurrences, first_row from {_dedup}")
def dedupe_context(spark, sf_dir):
    """M4: all of them; the operator's limit is for what a costly caller takes."""
    return M.dedupe_context(_contexts(spark, sf_dir), None).select("anchor_key", "anchor_value", "context_text", "occurrences", "first_row")


_aliases = "(select lower(trim(p_name)) as anchor_key, min(trim(p_type)) as canonical_name from part group by 1 having count(*) > 20)"
_input = f"(select d.anchor_key as id, d.context_text || coalesce('. Canonical entity: ' || a.canonical_name, '') as context_text, d.occurrences, a.canonical_name from {_dedup} d left join {_aliases} a on a.anchor_key = d.anchor_key)"


def _inputs(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    known = part.groupBy(F.lower(F.trim("p_name")).alias("anchor_key")).agg(F.min(F.trim("p_type")).alias("canonical_name"), F.count("*").alias("n")).filter("n > 20").drop("n")
    out = M.resolve_anchor(M.dedupe_context(_contexts(spark, sf_dir), None), known.withColumn("anchor_column", F.lit("p_name")))
    return scratch.stored(out.select(F.col("anchor_key").alias("id"), "context_text", "occurrences", "canonical_name"), "inputs")


@query(f"select * from {_input}")
def resolve_anchor(spark, sf_dir):
    """M5: contexts whose anchor is a known entity name it."""
    return _inputs(spark, sf_dir)


_tax = "(select distinct trim(p_type) || ' > ' || trim(p_brand) as category, 'resource_tower' as layer, trim(p_type) || ' > ' || trim(p_brand) as path, trim(p_type) || '. ' || trim(p_brand) as search_text from part)"


def _taxonomy(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    rows = part.select(F.col("p_type").alias("level_1"), F.col("p_brand").alias("level_2"), F.lit(None).cast("string").alias("level_3"), F.lit(None).cast("string").alias("description"), F.lit("no").alias("retired")).distinct()
    return S.load_taxonomy(rows, "resource_tower").select(F.col("path").alias("category"), "layer", "path", "search_text")


_stop = _in(rules.STOP_WORDS)
_tok = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: len(t) > 2 and t not in {_stop})"
_lex = lambda c, p, s: f"case when len({_tok(c)}) = 0 then cast(0 as double) else cast(len(list_filter({_tok(c)}, lambda t: contains(lower({p} || ' ' || {s}), t))) as double) / len({_tok(c)}) end"
_rule = lambda c, p: "case " + " ".join(f"when regexp_matches(lower({c}), '{a}') and regexp_matches(lower({p}), '{b}') then '{x}'" for a, b, x in RULES) + " end"


@query(f"select i.id, t.category, {_lex('i.context_text', 't.path', 't.search_text')} as lexical from {_input} i, {_tax} t")
def lexical_score(spark, sf_dir):
    """M6: every context against every category (both bounded by the vocabulary)."""
    both = _inputs(spark, sf_dir).join(_taxonomy(spark, sf_dir), F.lit(True))
    return both.select("id", "category", text.lexical_score(F.col("context_text"), F.col("path"), F.col("search_text")).alias("lexical"))


@query(f"select i.id, t.category, {_rule('i.context_text', 't.path')} as rule from {_input} i, {_tax} t where {_rule('i.context_text', 't.path')} is not null")
def rule_score(spark, sf_dir):
    """M7, with a rule table of its own."""
    both = _inputs(spark, sf_dir).join(_taxonomy(spark, sf_dir), F.lit(True))
    return both.select("id", "category", text.rule_label(F.col("context_text"), F.col("path"), F.col("layer"), RULES).alias("rule")).filter("rule is not null")


def _hash_sql(source: str, key: str, col: str) -> str:
    return f"""(with t as (select {key} as key, lower(trim({col})) as s from {source}), ch as (select key, unnest(range(0, len(s))) as i, s from t), co as (select key, i, ascii(s[i + 1]) as c from ch),
raw as (select key, (c * (i + 1)) % 1536 as idx, sum(sin(c + i)) as v from co group by all) select key, idx, v / sqrt(sum(v * v) over (partition by key)) as w from raw)"""


_ranked = f"""(with qv as {_hash_sql(_input, 'id', 'context_text')}, tv as {_hash_sql(_tax, 'category', 'search_text')},
d as (select q.key as id, t.key as category, round(1 - sum(q.w * t.w), 9) as distance from qv q join tv t on t.idx = q.idx group by 1, 2),
near as (select * from (select *, row_number() over (partition by id order by distance, category) as rn from d) where rn <= 20),
s as (select n.id, n.category, t.path, n.distance, greatest(0, 1 - n.distance) as similarity, {_lex('i.context_text', 't.path', 't.search_text')} as lexical, cast(null as varchar) as rule from near n join {_input} i on i.id = n.id join {_tax} t on t.category = n.category),
r as (select *, round(cast(0.6 as double) * similarity + cast(0.2 as double) * lexical, 3) as score from s)
select *, row_number() over (partition by id order by score desc, distance, category) as rank from r)"""


def _near(spark, sf_dir):
    inputs, tax = _inputs(spark, sf_dir), scratch.stored(_taxonomy(spark, sf_dir), "taxonomy")
    q, t = V.hash_embed(inputs, "id", "context_text"), V.hash_embed(tax, "category", "search_text")
    d = q.join(t.select(F.col("key").alias("category"), "idx", F.col("w").alias("wt")), "idx").groupBy(F.col("key").alias("id"), "category").agg(F.round(1 - F.sum(F.col("w") * F.col("wt")), 9).alias("distance"))
    return inputs, d, tax


def _rank(spark, sf_dir):
    inputs, d, tax = _near(spark, sf_dir)
    return scratch.stored(M.rank_candidates(inputs, d, tax), "ranked"), inputs


@query(f"select id, category, cast(rank as bigint) as rank, score from {_ranked}")
def rank_candidates(spark, sf_dir):
    """M8."""
    return _rank(spark, sf_dir)[0].select("id", "category", F.col("rank").cast("long").alias("rank"), "score")


@query(f"select id, category, round(cast(0.65 as double) * score + cast(0.35 as double) * 0.9, 3) as final from {_ranked} where rank = 2")
def mapping_verdicts(spark, sf_dir):
    """M9: an outside verdict that takes the second candidate of each context."""
    ranked, inputs = _rank(spark, sf_dir)
    v = inputs.select("id", F.lit(2).alias("choice"), F.lit(0.9).alias("confidence"))
    return M.apply_mapping_verdicts(ranked, v).filter("chosen").select("id", "category", "final")


_decided = f"(select id, case when score >= 0.35 then category end as category, case when score >= 0.35 then path end as path, case when score < 0.35 then 'unresolved' when score >= 0.85 then 'approved' else 'suggested' end as status, score as confidence from {_ranked} where rank = 1)"


def _decide(spark, sf_dir):
    return scratch.stored(M.decide_mapping(_rank(spark, sf_dir)[0]), "mappings")


@query(f"select id, category, status, confidence, case when status = 'unresolved' then 'unresolved' else 'hybrid' end as method from {_decided}")
def decide_mapping(spark, sf_dir):
    """M10."""
    return _decide(spark, sf_dir).select("id", "category", "status", "confidence", "method")


@query(f"""select 'candidates' as metric, count(*) as n from {_input} union all select 'mapped', count(category) from {_decided} union all select 'auto', count(*) from {_decided} where status = 'approved'
union all select 'review', count(*) from {_decided} where status = 'suggested' union all select 'unresolved', count(*) from {_decided} where status = 'unresolved' union all select 'linked', count(canonical_name) from {_input}
union all select 'skipped', count(*) from {_input} i where not exists (select 1 from {_decided} d where d.id = i.id) union all select 'fallback', count(*) from {_input}""")
def run_mapping(spark, sf_dir):
    """The whole chain for one layer, and its counts; all vectors are hashes here."""
    inputs, d, tax = _near(spark, sf_dir)
    return M.run_mapping(inputs, d, tax, fallback=inputs)[1]


@query(f"select id, status, confidence from {_decided} where status = 'unresolved'")
def list_mappings(spark, sf_dir):
    """M12, M18."""
    return M.list_mappings(_decide(spark, sf_dir), "unresolved").select("id", "status", "confidence")


@query(f"select d.id, case when o.n % 2 = 0 then 'approved' else d.status end as status, d.confidence from {_decided} d join (select lower(trim(p_name)) as id, count(*) as n from part group by 1) o on o.id = d.id")
def upsert_mapping(spark, sf_dir):
    """Fresh mappings over a table in which every second one is approved."""
    fresh = _decide(spark, sf_dir).select("id", "status", "confidence")
    n = B.table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("id")).agg(F.count("*").alias("n"))
    old = n.select("id", F.when(F.col("n") % 2 == 0, "approved").otherwise("suggested").alias("status"), F.lit(0.1).alias("confidence"))
    return M.upsert_mappings(old, fresh)


_events = "(select lower(trim(p_name)) as id, case min(p_size) % 3 when 0 then 'approve' when 1 then 'reject' else 'override' end as action, max(trim(p_type) || ' > ' || trim(p_brand)) as category from part group by 1)"
_reviewed = f"(select d.id, case e.action when 'approve' then 'approved' when 'reject' then 'rejected' else 'overridden' end as status, case when e.action = 'override' then e.category else d.category end as category, case when e.action = 'override' then e.category else d.path end as path, case when e.action = 'override' then 1.0 else d.confidence end as confidence from {_decided} d join {_events} e on e.id = d.id)"


def _review(spark, sf_dir):
    e = B.table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("id")).agg(F.expr("case min(p_size) % 3 when 0 then 'approve' when 1 then 'reject' else 'override' end").alias("action"), F.max(F.concat_ws(" > ", F.trim("p_type"), F.trim("p_brand"))).alias("category"), F.lit(1).cast("long").alias("seq"))
    done = M.review_mappings(_decide(spark, sf_dir), e)
    return done.withColumn("path", F.when(F.col("status") == "overridden", F.col("category")).otherwise(F.col("path")))


@query(f"select id, status, category, cast(confidence as double) as confidence from {_reviewed}")
def review_mapping(spark, sf_dir):
    """Approve, reject and override, by events derived from the parts."""
    return _review(spark, sf_dir).select("id", "status", "category", "confidence")


_cat_edges = f"(select a.entity, r.path, cast(max(r.confidence) as double) as confidence, count(*) as mappings from {_reviewed} r join (select distinct lower(trim(p_name)) as id, 'service:' || trim(p_type) as entity from part) a on a.id = r.id where r.status in ('approved', 'overridden') and r.path is not null group by 1, 2)"


def _edges_to_categories(spark, sf_dir):
    aliases = B.table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("id"), F.concat(F.lit("service:"), F.trim("p_type")).alias("entity")).distinct()
    return M.category_edges(_review(spark, sf_dir), aliases)


@query(f"select * from {_cat_edges}")
def category_edges(spark, sf_dir):
    """M15, M16."""
    return _edges_to_categories(spark, sf_dir)


@query(f"""select 'total' as metric, 'all' as key, cast(count(*) as double) as n from {_decided} union all select 'classified', 'all', count(category) from {_decided} union all select 'coverage', 'all', round(cast(count(category) as double) / count(*), 6) from {_decided}
union all select 'mean_confidence', 'all', round(avg(confidence), 6) from {_decided} union all select 'status', status, count(*) from {_decided} group by 2 union all select 'level_2', split_part(path, ' > ', 2), count(*) from {_decided} where category is not null group by 2""")
def mapping_report(spark, sf_dir):
    """M17."""
    return M.mapping_report(_decide(spark, sf_dir)).withColumn("n", F.round("n", 6))


_two = f"(select 'part' as dataset, * from {_ctx} union all select 'customer', c_custkey, 'c_mktsegment', trim(c_mktsegment), 'Dataset type: Accounts. c_mktsegment: ' || trim(c_mktsegment) from customer)"


@query(f"select dataset, anchor_key, arg_min(context_text, row_no) as context_text, count(*) as occurrences from (select *, lower(anchor_value) as anchor_key from {_two}) group by 1, 2")
def dedupe_by_dataset(spark, sf_dir):
    """M4: contexts of two tables, each table's for itself."""
    own = M.row_context(B.table(spark, sf_dir, "customer"), {"c_mktsegment": "cost_center"}, F.col("c_custkey"), "Accounts")
    both = _contexts(spark, sf_dir).withColumn("dataset", F.lit("part")).unionByName(own.withColumn("dataset", F.lit("customer")))
    return M.dedupe_context(both, None).select("dataset", "anchor_key", "context_text", "occurrences")


def _placed(mappings):
    return mappings.withColumns({"dataset": F.lit("part"), "column_name": F.lit("name"), "value": F.col("id")})


def _catalogue(spark, sf_dir):
    files = B.row_counts(spark, sf_dir).select("dataset", F.concat("dataset", F.lit(".parquet")).alias("file_name"))
    return files, _columns(spark, sf_dir).select("dataset", "column_name", "role")


@query(f"select d.id as value, 'part.parquet' as file_name, 'service' as role, d.status, d.confidence, t.layer, t.path from {_decided} d left join {_tax} t on t.category = d.category")
def mapping_list(spark, sf_dir):
    """Mappings with their file, column and category; those without a category stay."""
    files, columns = _catalogue(spark, sf_dir)
    return M.mapping_list(_placed(_decide(spark, sf_dir)), files, columns, _taxonomy(spark, sf_dir)).select("value", "file_name", "role", "status", "confidence", "layer", "path")


@query(f"select a.entity, r.category, t.layer, t.path, 'part.parquet' as file_name, r.id as value, cast(r.confidence as double) as confidence from {_reviewed} r join {_tax} t on t.category = r.category join (select distinct lower(trim(p_name)) as id, 'service:' || trim(p_type) as entity from part) a on a.id = r.id where r.status in ('approved', 'overridden')")
def approved_mappings(spark, sf_dir):
    """What review approved, with category, file and every entity whose alias the value is."""
    files, _ = _catalogue(spark, sf_dir)
    aliases = B.table(spark, sf_dir, "part").select(F.lit("part").alias("dataset"), F.lit("name").alias("column_name"), F.trim("p_name").alias("value"), F.concat(F.lit("service:"), F.trim("p_type")).alias("entity"))
    return M.approved_mappings(_placed(_review(spark, sf_dir)), _taxonomy(spark, sf_dir), files, aliases)


@query(f"select d.id, case e.action when 'approve' then 'approved' when 'reject' then 'rejected' else 'overridden' end as status, 'reviewer ' || e.k as reviewed_by, e.k as reviewed_at from {_decided} d join (select lower(trim(p_name)) as id, case min(p_size) % 3 when 0 then 'approve' when 1 then 'reject' else 'override' end as action, max(p_partkey) as k from part group by 1) e on e.id = d.id")
def review_trail(spark, sf_dir):
    """Who reviewed a mapping last, and when."""
    e = B.table(spark, sf_dir, "part").groupBy(F.lower(F.trim("p_name")).alias("id")).agg(F.expr("case min(p_size) % 3 when 0 then 'approve' when 1 then 'reject' else 'override' end").alias("action"), F.lit("x").alias("category"), F.max("p_partkey").alias("at"))
    e = e.withColumns({"seq": F.lit(2).cast("long"), "reviewer": F.concat(F.lit("reviewer "), F.col("at"))})
    return M.review_mappings(_decide(spark, sf_dir), e).select("id", "status", "reviewed_by", "reviewed_at")


# --- the output model ------------------------------------------------------------------------------------------
# Nodes and edges of the sales graph; a class for every application, in two layers, from the parts that carry it.

_nodes = graphs._nodes
_edges = f"(select *, case when edge_type = 'co_occurs_with' then cast(null as varchar) else edge_type end as label, case when split_part(from_id, ':', 1) = 'vendor' or split_part(to_id, ':', 1) = 'vendor' then 'supplier' else 'part' end as dataset from {graphs._cooc})"
_classes = """(select 'application:' || lower(trim(p_brand)) as id, 'resource_tower' as layer, trim(p_type) as level_1, 'size ' || p_size as level_2, trim(p_type) || ' > size ' || p_size as path, cast(round(p_size / 50.0, 2) as double) as confidence from part
union all select 'application:' || lower(trim(p_brand)), 'cost_pool', trim(p_type), null, trim(p_type), cast(round(p_size / 100.0, 2) as double) from part)"""
_best = f"(select * from (select *, row_number() over (partition by id, layer order by confidence desc, path) as rn from (select distinct * from {_classes})) where rn = 1)"
_sources = f"(select id, string_agg(file_name, '; ' order by file_name) as sources from (select distinct e.id, e.dataset || '.parquet' as file_name from (select from_id as id, dataset from {_edges} union all select to_id, dataset from {_edges}) e) group by 1)"
_objects = f"""(select n.id, n.name, n.entity_type, w.cost_pool, w.resource_tower, w.mapping_confidence, s.sources from {_nodes} n left join (select id, max(case when layer = 'cost_pool' then level_1 end) as cost_pool, max(case when layer = 'resource_tower' then coalesce(level_2, level_1) end) as resource_tower, round(avg(confidence), 3) as mapping_confidence from {_best} group by 1) w on w.id = n.id left join {_sources} s on s.id = n.id)"""


def _model_classes(spark, sf_dir):
    """Classes of the applications, from the parts alone."""
    part = B.table(spark, sf_dir, "part")
    own = F.concat(F.lit("application:"), text.normalised(F.col("p_brand"))).alias("id")
    kind, size = F.trim("p_type"), F.concat(F.lit("size "), F.col("p_size"))
    tower = part.select(own, F.lit("resource_tower").alias("layer"), kind.alias("level_1"), size.alias("level_2"), F.concat_ws(" > ", kind, size).alias("path"), F.round(F.col("p_size") / 50, 2).alias("confidence"))
    pool = part.select(own, F.lit("cost_pool").alias("layer"), kind.alias("level_1"), F.lit(None).cast("string").alias("level_2"), kind.alias("path"), F.round(F.col("p_size") / 100, 2).alias("confidence"))
    return tower.unionByName(pool).distinct()


def _model_datasets(spark, sf_dir):
    """(tables that give evidence, the same with their readiness): from the files' footers."""
    datasets = B.row_counts(spark, sf_dir, ("part", "supplier", "orders")).withColumn("file_name", F.concat("dataset", F.lit(".parquet")))
    scores = datasets.select("dataset", F.when(F.col("dataset") == "part", 0.9).otherwise(0.6).alias("overall"), F.lit(1).alias("issue_count"), F.lit(0).alias("critical_issue_count")).filter("dataset <> 'orders'")
    return datasets, A.source_datasets(datasets, scores)


def _model_edges(spark, sf_dir):
    """(nodes, edges with their label and table, tables that give evidence, the same with their readiness)."""
    nodes, edges = graphs._graph(spark, sf_dir)
    nodes = scratch.stored(nodes.withColumn("alias_count", F.lit(1).cast("long")), "nodes")
    vendor = (F.substring_index("from_id", ":", 1) == "vendor") | (F.substring_index("to_id", ":", 1) == "vendor")
    edges = edges.withColumn("label", F.when(F.col("edge_type") != "co_occurs_with", F.col("edge_type"))).withColumn("dataset", F.when(vendor, "supplier").otherwise("part"))
    return nodes, edges, *_model_datasets(spark, sf_dir)


def _model(spark, sf_dir):
    nodes, edges, datasets, sources = _model_edges(spark, sf_dir)
    objs = scratch.stored(A.objects(nodes, _model_classes(spark, sf_dir), A.entity_sources(edges, datasets)), "objects")
    return objs, A.relationships(edges, nodes, datasets), sources, edges, datasets


@query(f"select id, sources from {_sources}")
def entity_sources(spark, sf_dir):
    """A1."""
    _, _, _, edges, datasets = _model(spark, sf_dir)
    return A.entity_sources(edges, datasets).withColumn("sources", F.array_join("sources", "; "))


@query(f"select id, layer, path, confidence from {_best}")
def best_classification(spark, sf_dir):
    """A2."""
    return A.best_classification(_model_classes(spark, sf_dir)).select("id", "layer", "path", "confidence")


@query(f"select id, name, entity_type, cost_pool, resource_tower, mapping_confidence, sources from {_objects}")
def model_objects(spark, sf_dir):
    """A3."""
    return _model(spark, sf_dir)[0].select("id", "name", "entity_type", "cost_pool", "resource_tower", "mapping_confidence", F.array_join("sources", "; ").alias("sources"))


@query(f"select from_id, to_id, coalesce(label, edge_type) as relationship, split_part(to_id, ':', 1) as to_type, confidence, dataset || '.parquet' as evidence from {_edges}")
def model_relationships(spark, sf_dir):
    """A4."""
    nodes, edges, datasets, _ = _model_edges(spark, sf_dir)
    return A.relationships(edges, nodes, datasets).select("from_id", "to_id", "relationship", "to_type", "confidence", "evidence")


@query("select dataset, dataset || '.parquet' as file_name, row_count, cast(case dataset when 'part' then 0.9 when 'supplier' then 0.6 end as double) as readiness_score, dataset = 'part' as is_ready from (" + B.sql_counts(("part", "supplier", "orders")) + ")")
def source_datasets(spark, sf_dir):
    """A5."""
    return _model_datasets(spark, sf_dir)[1].select("dataset", "file_name", "row_count", "readiness_score", "is_ready")


@query(f"""select 'objects' as metric, 'all' as key, cast(count(*) as double) as value from {_objects} union all select 'classified', 'all', count(mapping_confidence) from {_objects} union all select 'coverage', 'all', round(cast(count(mapping_confidence) as double) / count(*), 3) from {_objects}
union all select 'relationships', 'all', count(*) from {_edges} union all select 'datasets', 'all', 3 union all select 'ready', 'all', 1 union all select 'mean_readiness', 'all', 0.75 union all select 'mean_confidence', 'all', round(coalesce(avg(mapping_confidence), 0), 3) from {_objects}
union all select 'type', entity_type, count(*) from {_objects} group by 2 union all select 'tower', resource_tower, count(*) from {_objects} where resource_tower is not null group by 2""")
def model_summary(spark, sf_dir):
    """A6."""
    objs, rels, sources, *_ = _model(spark, sf_dir)
    return A.model_summary(objs, rels, sources)


@query(f"""select 2 as seq, count(*) filter (mapping_confidence is null) || ' of ' || count(*) || ' object(s) have no approved classification and stay unallocated. Approve more mappings to close the gap.' as warning from {_objects}
union all select 3, '2 source dataset(s) score below the 0.7 readiness threshold: orders.parquet, supplier.parquet.'""")
def model_warnings(spark, sf_dir):
    """A7."""
    objs, rels, sources, *_ = _model(spark, sf_dir)
    return A.model_warnings(objs, rels, sources)


@query(f"select id, name from {_objects} where entity_type = 'vendor'")
def filter_objects(spark, sf_dir):
    """A8."""
    return A.filter_objects(_model(spark, sf_dir)[0], "vendor").select("id", "name")


@query(f"select array_to_string(list_transform(string_split(entity_type, '_'), lambda t: upper(t[1]) || t[2:]), ' ') || 's' as sheet, id, coalesce(cost_pool, '') as cost_pool, coalesce(resource_tower, '') as resource_tower, coalesce(sources, '') as sources from {_objects}")
def export_model(spark, sf_dir):
    """The model, exported to a place of its own and read back: its objects, a folder per type."""
    objs, rels, sources, *_ = _model(spark, sf_dir)
    to = scratch.path(spark, "model")
    A.export_model(objs, rels, sources, A.model_summary(objs, rels, sources), to)
    return spark.read.parquet(f"{to}/objects").select("sheet", "id", "cost_pool", "resource_tower", "sources")


@query("select dataset, column_name, value as corrected, count(*) as n from " + quality._fixed + " where column_name = 'currency' group by 1, 2, 3")
def write_corrected_copy(spark, sf_dir):
    """Corrected cells, written to a place of their own and read back."""
    from ..operators import corrections as K

    cells = quality._cells(spark, sf_dir).filter("column_name = 'currency'")
    fixed, _ = K.apply_corrections(cells, quality._proposed_corrections(spark, sf_dir))
    to = S.write_corrected_copy(fixed.select("dataset", "column_name", F.col("value").alias("corrected")), scratch.path(spark, "billing"), "1")
    return spark.read.parquet(to).groupBy("dataset", "column_name", "corrected").agg(F.count("*").alias("n"))


@query("select n_name as nation, o_orderstatus as status, round(sum(o_totalprice), 2) as cost, count(*) as n from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by rollup (n_name, o_orderstatus)")
def cost_by(spark, sf_dir):
    """Extension: cost by nation and status, with subtotals."""
    t = lambda n: B.table(spark, sf_dir, n)
    facts = t("orders").select("o_custkey", "o_orderstatus", "o_totalprice").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(F.broadcast(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))), "c_nationkey")
    return A.cost_by(facts.withColumnRenamed("o_orderstatus", "status"), ["nation", "status"], "o_totalprice").withColumn("cost", F.round("cost", 2))


@query("select status, strftime(month, '%Y-%m') as month, round(cost, 2) as cost, round(cost - lag(cost) over (partition by status order by month), 2) as change from (select o_orderstatus as status, date_trunc('month', o_orderdate) as month, sum(o_totalprice) as cost from orders group by 1, 2)")
def month_over_month(spark, sf_dir):
    """Extension: monthly cost and its change."""
    out = A.month_over_month(B.table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_orderdate", "o_totalprice")
    return out.select("status", F.date_format("month", "yyyy-MM").alias("month"), F.round("cost", 2).alias("cost"), F.round("change", 2).alias("change"))


_month_no = lambda c: f"year({c}) * 12 + month({c}) - 1"


@query(f"""select *, known >= 3 and coalesce(cost > mean + 2 * deviation, false) as is_spike from (select status, segment, month_no, cost, avg(cost) over w as mean, stddev_pop(cost) over w as deviation, count(cost) over w as known, month_no - lag(month_no) over (partition by status, segment order by month_no) - 1 as gap
from (select o_orderstatus as status, c_mktsegment as segment, {_month_no("o_orderdate")} as month_no, sum(o_totalprice) as cost from orders join customer on c_custkey = o_custkey group by all) window w as (partition by status, segment order by month_no range between 6 preceding and 1 preceding))""")
def cost_spikes(spark, sf_dir):
    """Extension: months whose cost leaves the range of the six before, by status and segment."""
    t = lambda n: B.table(spark, sf_dir, n)
    facts = t("orders").select("o_custkey", "o_orderdate", "o_totalprice", F.col("o_orderstatus").alias("status")).join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    return A.cost_spikes(facts, ["status", "segment"], "o_orderdate", "o_totalprice")


@query(f"""with m as (select l_partkey as service, {_month_no("l_shipdate")} as month_no, sum(l_extendedprice) as cost from lineitem where l_shipdate is not null group by all),
e as (select *, sum(cost) over (partition by service order by month_no range between current row and 2 following) as early from m)
select service, min(month_no) as first_month_no, round(arg_min(cost, month_no), 4) as first_cost, round(arg_min(early, month_no), 4) as early_cost, count(*) as months_seen, min(month_no) > (select max(month_no) from m) - 3 as is_new from e group by 1""")
def new_services(spark, sf_dir):
    """Extension: when each part was first shipped, what it cost then, and whether that is lately."""
    out = A.new_services(B.table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "service"), "service", "l_shipdate", "l_extendedprice")
    return out.withColumns({"first_cost": F.round("first_cost", 4), "early_cost": F.round("early_cost", 4)})


_whole = quality._fixed
_best = f"(select lower(trim(original)) as norm, arg_max(corrected, (confidence, -rk)) as corrected from (select *, row_number() over (order by original) as rk from {quality._proposed}) where dataset = 'billing' and column_name = 'currency' group by 1)"


@query(f"select c_custkey as account, coalesce(f.corrected, b.currency) as currency, b.amount from (select c_custkey, {quality.DIRTY['billing'][1]['currency']} as currency, {quality.DIRTY['billing'][1]['amount']} as amount from customer) b left join {_best} f on f.norm = lower(trim(b.currency))")
def corrected_table(spark, sf_dir):
    """A whole table with its corrections, written beside the source and read back with all columns."""
    from ..operators import corrections as K

    fixed = K.corrected_table(quality.dirty(spark, sf_dir)["billing"], "billing", quality._proposed_corrections(spark, sf_dir))
    return spark.read.parquet(S.write_corrected_copy(fixed, scratch.path(spark, "billing"), "1"))
