"""Queries on quality, corrections and readiness (Q), with their SQL twins.

The driver's tables are clean, so four business tables are derived from all rows of them, with currencies, dates, references and
blanks that need work. The expressions read the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import corrections as K
from ..operators import profile as P
from ..operators import quality as Q
from ..sources import scratch
from ..sources import tables as S
from . import base as B

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_y, _m, _d = (f"cast({f}(o_orderdate) as string)" for f in ("year", "month", "day"))
_iso = f"concat({_y}, '-', lpad({_m}, 2, '0'), '-', lpad({_d}, 2, '0'))"
DIRTY = {
    "billing": ("customer", {"account": "c_custkey", "currency": "case c_custkey % 7 when 0 then ' usd' when 1 then '$' when 2 then 'euro' when 3 then 'XXX' when 4 then 'EUR' else 'USD' end", "amount": "c_acctbal * case when c_custkey % 97 = 0 then 50 else 1 end"}),
    "inventory": ("part", {"item": "p_partkey", "brand": "case p_partkey % 11 when 0 then concat(' ', p_brand) when 1 then concat(p_brand, ' ') else p_brand end", "amount": "p_retailprice"}),
    "schedule": ("orders", {"task": "o_orderkey", "due_date": f"case o_orderkey % 5 when 0 then concat({_m}, '/', {_d}, '/', {_y}) when 1 then concat({_d}, '.', {_m}, '.', {_y}) when 2 then 'soon' else {_iso} end", "amount": "case when o_orderkey % 5 = 2 then 'n/a' else cast(cast(o_totalprice as decimal(18, 2)) as string) end"}),
    "shipments": ("lineitem", {"task": "l_orderkey", "line": "l_linenumber", "flag": "case when l_linenumber = 1 then l_returnflag end", "remark": "case when l_quantity > 45 then l_linestatus end", "amount": "l_extendedprice"}),
}
_KINDS = {"account": "long", "item": "long", "task": "long", "line": "int", "amount": "double"}
#: dataset, column, role, technical; and each table's source.
ROLES = [(d, c, {"amount": "cost_amount", "due_date": "date", "brand": "application"}.get(c, "identifier" if c in ("account", "item", "task", "line") else "other"), c in ("account", "item", "task", "line")) for d, (_, cols) in DIRTY.items() for c in cols]
SOURCES = [("billing", "ERP"), ("schedule", "ERP"), ("shipments", "ERP"), ("inventory", "CMDB")]
REQUIRED = 0.3


def dirty(spark, sf_dir):
    return {d: B.table(spark, sf_dir, t).selectExpr(*[f"{e} as {c}" for c, e in cols.items()]) for d, (t, cols) in DIRTY.items()}


def _cells(spark, sf_dir):
    frames = [S.cells(df, d, rename=str) for d, df in dirty(spark, sf_dir).items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _profile(spark, sf_dir):
    return P.column_types(dirty(spark, sf_dir), rename=str)


def _counted(spark, sf_dir, columns):
    """Counted values of the given columns (dataset, column_name) alone: as many as the catalogue gives."""
    wanted = {(r.dataset, r.column_name) for r in columns.select("dataset", "column_name").collect()}
    return scratch.stored(P.value_counts(dirty(spark, sf_dir), wanted, rename=str), "values")


def _column(spark, sf_dir, dataset, column):
    """The cells of one column: nothing else is read."""
    return S.cells(dirty(spark, sf_dir)[dataset].select(column), dataset, rename=str)


def _columns(spark, profile):
    roles = spark.createDataFrame(ROLES, "dataset string, column_name string, role string, is_technical boolean")
    sources = spark.createDataFrame(SOURCES, "dataset string, source_type string")
    return profile.join(F.broadcast(roles), ["dataset", "column_name"]).join(F.broadcast(sources), "dataset")


def _names(spark, sf_dir):
    """Canonical brands: those that enough parts have."""
    n = B.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("canonical_name")).agg(F.count("*").alias("n"))
    return n.filter("canonical_name not like '%5'").select(F.lit("application").alias("role"), "canonical_name")


def _issues(spark, sf_dir):
    profile = _profile(spark, sf_dir)
    columns = _columns(spark, profile)
    schemas = Q.canonical_schemas(columns, REQUIRED)
    named = columns.filter(F.col("role").isin(*rules.EMBEDDABLE_ROLES) | F.lower("column_name").contains("currency"))
    cells = _counted(spark, sf_dir, Q.dated(profile).union(named.select("dataset", "column_name")))
    parts = [Q.missing_values(profile), Q.schema_mismatches(columns, schemas), Q.invalid_currencies(cells), Q.invalid_dates(cells, profile), Q.column_outliers(dirty(spark, sf_dir), profile, rename=str), Q.invalid_references(cells, columns, _names(spark, sf_dir)), Q.duplicates(dirty(spark, sf_dir)["shipments"], "shipments", ["task", "line"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return scratch.stored(out, "issues"), columns, schemas


# --- SQL twins -------------------------------------------------------------------------------------------------

_c = " union all ".join(f"select '{d}' as dataset, '{c}' as column_name, {i} as ordinal, {B.sql_text('(' + e + ')', 'string' if (d, c) == ('schedule', 'amount') else _KINDS.get(c, 'string'))} as value from {t}" for d, (t, cols) in DIRTY.items() for i, (c, e) in enumerate(cols.items()))
_p = f"""(with vals as (select dataset, column_name, ordinal, value, count(*) as n, (value is null or value = '') as empty, case when value is null or value = '' then true else {B.SQL_DATE} is not null and length(value) >= 8 end as d,
case when value is null or value = '' then true else try_cast(value as double) is not null end as num from ({_c}) group by all)
select dataset, column_name, ordinal, cast(sum(n) as bigint) as row_count, cast(sum(case when empty then n else 0 end) as bigint) as nulls, case when count(*) filter (not empty) = 0 then 'unknown' when bool_and(d) then 'date' when bool_and(num) then 'number' else 'string' end as inferred_type from vals group by 1, 2, 3)"""
_cols = f"(select p.*, r.role, r.is_technical, s.source_type from {_p} p join ({B.sql_values(ROLES)}) as r(dataset, column_name, role, is_technical) on r.dataset = p.dataset and r.column_name = p.column_name join ({B.sql_values(SOURCES)}) as s(dataset, source_type) on s.dataset = p.dataset)"
_schemas = f"(select c.source_type, c.role, arg_min(c.column_name, c.dataset || lpad(cast(c.ordinal as varchar), 4, '0')) as column_name, arg_min(c.inferred_type, c.dataset || lpad(cast(c.ordinal as varchar), 4, '0')) as inferred_type, cast(count(distinct c.dataset) as double) / any_value(t.total) as frequency, frequency >= {REQUIRED} as is_required from {_cols} c join (select source_type, count(distinct dataset) as total from ({B.sql_values(SOURCES)}) as s(dataset, source_type) group by 1) t on t.source_type = c.source_type where not c.is_technical group by 1, 2)"
_missing = f"select dataset, column_name, 'missing_value' as issue_type, case when nulls > 0.8 * row_count then 'error' else 'warning' end as severity, nulls as affected_rows from {_p} where nulls > 0.5 * row_count"
_mismatch = f"select c.dataset, c.column_name, 'schema_mismatch' as issue_type, 'warning' as severity, cast(null as bigint) as affected_rows from {_cols} c join {_schemas} s on s.source_type = c.source_type and s.role = c.role where c.inferred_type <> s.inferred_type"
_codes = ", ".join(f"'{c}'" for c in rules.CURRENCIES)
_currency = f"select dataset, column_name, 'invalid_currency' as issue_type, 'error' as severity, count(*) as affected_rows from ({_c}) where contains(lower(column_name), 'currency') and trim(value) <> '' and upper(trim(value)) not in ({_codes}) group by 1, 2"
_dates = f"select c.dataset, c.column_name, 'invalid_date' as issue_type, 'warning' as severity, count(*) as affected_rows from ({_c}) c join {_p} p on p.dataset = c.dataset and p.column_name = c.column_name where (p.inferred_type = 'date' or contains(lower(p.column_name), 'date')) and value <> '' and {B.SQL_DATE} is null group by 1, 2"
_num = f"(select c.dataset, c.column_name, try_cast(c.value as double) as x from ({_c}) c join {_p} p on p.dataset = c.dataset and p.column_name = c.column_name where p.inferred_type = 'number' and try_cast(c.value as double) is not null)"
_outliers = f"select n.dataset, n.column_name, 'outlier' as issue_type, 'info' as severity, count(*) as affected_rows from {_num} n join (select dataset, column_name, count(*) as k, avg(x) as m, stddev_pop(x) as s from {_num} group by 1, 2) t on t.dataset = n.dataset and t.column_name = n.column_name where t.k > 10 and t.s > 0 and abs(n.x - t.m) > 3 * t.s group by 1, 2"
_refs = f"select dataset, column_name, 'invalid_reference' as issue_type, 'warning' as severity, count(*) as affected_rows from ({_c}) where dataset = 'inventory' and column_name = 'brand' and value <> '' and lower(trim(value)) not in (select lower(p_brand) from part where p_brand not like '%5') group by 1, 2"
_dups = "select 'shipments' as dataset, cast(null as varchar) as column_name, 'duplicate' as issue_type, case when extra > 0.1 * total then 'error' else 'warning' end as severity, extra as affected_rows from (select cast(sum(n - 1) as bigint) as extra, sum(n) as total from (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2)) where extra > 0"
_all = "(" + " union all ".join(f"({x})" for x in (_missing, _mismatch, _currency, _dates, _outliers, _refs, _dups)) + ")"
_penalty = "case severity " + " ".join(f"when '{k}' then {v}" for k, v in rules.SEVERITY_PENALTY.items()) + " else 0.05 end"
_ready = f"""(select c.dataset, c.source_type, cast(coalesce(k.completeness, 1) as double) as completeness, cast(coalesce(i.validity, 1) as double) as validity, cast(coalesce(i.consistency, 1) as double) as consistency,
case when i.repeated > 0 then 1 - cast(i.repeated as double) / n.row_count else 1 end as uniqueness, round(completeness * cast(0.25 as double) + validity * cast(0.30 as double) + consistency * cast(0.25 as double) + uniqueness * cast(0.20 as double), 3) as overall,
coalesce(i.issue_count, 0) as issue_count, coalesce(i.critical, 0) as critical_issue_count
from ({B.sql_values(SOURCES)}) as c(dataset, source_type) join ({" union all ".join(f"select '{d}' as dataset, count(*) as row_count from {t}" for d, (t, _) in DIRTY.items())}) n on n.dataset = c.dataset
left join (select s.dataset, cast(count(h.role) as double) / count(*) as completeness from (select r.dataset, q.role from ({B.sql_values(SOURCES)}) as r(dataset, source_type) join {_schemas} q on q.source_type = r.source_type and q.is_required) s left join (select distinct dataset, role from {_cols} where not is_technical) h on h.dataset = s.dataset and h.role = s.role group by 1) k on k.dataset = c.dataset
left join (select dataset, count(*) as issue_count, count(*) filter (severity in ('critical', 'error')) as critical, greatest(0, 1 - coalesce(sum(case when issue_type in ('invalid_date', 'invalid_currency', 'invalid_reference', 'missing_value') then cast({_penalty} as double) end), 0)) as validity,
1 - least(0.1 * count(*) filter (issue_type = 'invalid_reference'), 0.5) as consistency, max(case when issue_type = 'duplicate' then affected_rows end) as repeated from {_all} group by 1) i on i.dataset = c.dataset)"""
_PLAIN = ("dataset", "column_name", "issue_type", "severity", "affected_rows")


@query(f"select source_type, role, column_name, inferred_type, frequency, is_required from {_schemas}")
def canonical_schemas(spark, sf_dir):
    """Q1, Q2."""
    return Q.list_schemas(Q.canonical_schemas(_columns(spark, _profile(spark, sf_dir)), REQUIRED))


@query(_missing)
def issues_missing(spark, sf_dir):
    """Q3."""
    return Q.missing_values(_profile(spark, sf_dir)).select(*_PLAIN)


@query(f"select dataset, column_name, issue_type, severity from ({_mismatch})")
def issues_schema(spark, sf_dir):
    """Q4."""
    columns = _columns(spark, _profile(spark, sf_dir))
    return Q.schema_mismatches(columns, Q.canonical_schemas(columns, REQUIRED)).select(*_PLAIN[:4])


@query(f"select i.*, s.samples from ({_currency}) i join (select dataset, column_name, string_agg(code, '|' order by code) as samples from (select distinct dataset, column_name, upper(trim(value)) as code from ({_c}) where contains(lower(column_name), 'currency') and upper(trim(value)) not in ({_codes}, '')) group by 1, 2) s on s.dataset = i.dataset and s.column_name = i.column_name")
def issues_currency(spark, sf_dir):
    """Q5."""
    return Q.invalid_currencies(_column(spark, sf_dir, "billing", "currency")).withColumn("samples", F.array_join("samples", "|"))


@query(_dates)
def issues_date(spark, sf_dir):
    """Q6."""
    profile = _profile(spark, sf_dir)
    return Q.invalid_dates(_counted(spark, sf_dir, Q.dated(profile)), profile).select(*_PLAIN)


@query(_outliers)
def issues_outlier(spark, sf_dir):
    """Q7."""
    return Q.column_outliers(dirty(spark, sf_dir), _profile(spark, sf_dir), rename=str).select(*_PLAIN)


@query("select event_type as dataset, count(*) as affected_rows from (select event_type, value, avg(value) over (partition by event_type) as m, stddev_pop(value) over (partition by event_type) as s from events) where abs(value - m) > 3 * s group by 1")
def outliers_by_group(spark, sf_dir):
    """Q7 on the events, each type a table of its own."""
    e = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), F.lit("value").alias("column_name"), F.col("value").cast("string").alias("value"))
    return Q.outliers(e, e.select("dataset", "column_name", F.lit("number").alias("inferred_type")).distinct()).select("dataset", "affected_rows")


@query(_refs)
def issues_reference(spark, sf_dir):
    """Q8."""
    columns = _columns(spark, _profile(spark, sf_dir))
    return Q.invalid_references(_counted(spark, sf_dir, columns.filter(F.col("role").isin(*rules.EMBEDDABLE_ROLES))), columns, _names(spark, sf_dir)).select(*_PLAIN)


@query(_dups)
def issues_duplicate(spark, sf_dir):
    """Q9: repeated keys."""
    return Q.duplicates(dirty(spark, sf_dir)["shipments"], "shipments", ["task", "line"]).select(*_PLAIN)


@query("select 'documents' as dataset, case when extra > 0.1 * total then 'error' else 'warning' end as severity, extra as affected_rows from (select cast(sum(n - 1) as bigint) as extra, sum(n) as total from (select text, count(*) as n from documents group by 1)) where extra > 0")
def duplicate_texts(spark, sf_dir):
    """Q9 on whole texts; the key is a digest, so that no text is shuffled."""
    docs = B.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return Q.duplicates(docs, "documents", ["digest"]).select("dataset", "severity", "affected_rows")


@query(f"select dataset, column_name, issue_type, severity, coalesce(affected_rows, 0) as affected_rows from {_all} where severity in ('error', 'warning')")
def list_issues(spark, sf_dir):
    """Q10."""
    issues, _, _ = _issues(spark, sf_dir)
    return Q.list_issues(issues.filter("severity in ('error', 'warning')")).select(*_PLAIN[:4], F.coalesce("affected_rows", F.lit(0)).alias("affected_rows"))


_bad = f"(select distinct dataset, column_name, value from ({_c}))"
_syn = B.sql_values(rules.CURRENCY_SYNONYMS.items())
_prop_cur = f"select b.dataset, b.column_name, 'normalize_currency' as correction_type, b.value as original, s.code as corrected, cast(0.9 as double) as confidence from {_bad} b join ({_syn}) as s(word, code) on s.word = lower(trim(b.value)) where b.column_name = 'currency'"
_rx = {"us": r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "eu": r"^(\d{1,2})[-.](\d{1,2})[-.](\d{4})$", "slash": r"^(\d{4})/(\d{1,2})/(\d{1,2})$"}
_ex = lambda k, i, n=2: f"lpad(regexp_extract(trim(value), '{_rx[k]}', {i}), {n}, '0')"
_prop_date = f"""select * from (select dataset, column_name, 'normalize_date' as correction_type, value as original, case when regexp_matches(trim(value), '{_rx["us"]}') then concat_ws('-', {_ex("us", 3, 4)}, {_ex("us", 1)}, {_ex("us", 2)}) when regexp_matches(trim(value), '{_rx["eu"]}') then concat_ws('-', {_ex("eu", 3, 4)}, {_ex("eu", 2)}, {_ex("eu", 1)})
when regexp_matches(trim(value), '{_rx["slash"]}') then concat_ws('-', {_ex("slash", 1, 4)}, {_ex("slash", 2)}, {_ex("slash", 3)}) when regexp_matches(trim(value), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then trim(value) end as corrected, cast(0.7 as double) as confidence from {_bad} where column_name = 'due_date') where corrected is not null"""
_prop_trim = f"select dataset, column_name, 'trim_whitespace' as correction_type, value as original, trim(value) as corrected, cast(0.95 as double) as confidence from {_bad} where column_name = 'brand' and trim(value) <> value"
_proposed = f"(({_prop_cur}) union all ({_prop_date}) union all ({_prop_trim}))"


def _values(spark, sf_dir, column):
    dataset = next(d for d, (_, cols) in DIRTY.items() if column in cols)
    return _column(spark, sf_dir, dataset, column).filter(F.col("value").isNotNull()).select("dataset", "column_name", "value").distinct()


def _proposed_corrections(spark, sf_dir):
    v = lambda c: _values(spark, sf_dir, c)
    return K.propose_currency(v("currency")).unionByName(K.propose_dates(v("due_date"))).unionByName(K.propose_trim(v("brand")))


@query(_prop_cur)
def propose_currency(spark, sf_dir):
    """Q11."""
    return K.propose_currency(_values(spark, sf_dir, "currency"))


@query(_prop_date)
def propose_dates(spark, sf_dir):
    """Q12."""
    return K.propose_dates(_values(spark, sf_dir, "due_date"))


@query(_prop_trim)
def propose_trim(spark, sf_dir):
    """Q13."""
    return K.propose_trim(_values(spark, sf_dir, "brand"))


@query(f"select dataset, 'remove_duplicate' as correction_type, cast(0.7 as double) as confidence from ({_dups})")
def propose_duplicates(spark, sf_dir):
    """Q14."""
    found = Q.duplicates(dirty(spark, sf_dir)["shipments"], "shipments", ["task", "line"])
    return K.propose_duplicate_removal(found).select("dataset", "correction_type", "confidence")


@query(f"select dataset, column_name, original, case when correction_type = 'normalize_currency' then lower(corrected) || '!' else corrected end as corrected, cast(case when correction_type = 'normalize_currency' then 0.8 else confidence end as double) as confidence from {_proposed}")
def correction_verdicts(spark, sf_dir):
    """Q15: outside corrections for the currencies, UNKNOWN ones for the rest."""
    own = _proposed_corrections(spark, sf_dir)
    said = F.when(F.col("correction_type") == "normalize_currency", F.concat(F.lower("corrected"), F.lit("!"))).otherwise("unknown")
    verdicts = own.withColumn("corrected", said).withColumn("confidence", F.lit(None).cast("double"))
    return K.apply_verdicts(own, verdicts).select("dataset", "column_name", "original", "corrected", "confidence")


@query(f"select * from {_proposed} where dataset = 'inventory'")
def list_corrections(spark, sf_dir):
    """Q16."""
    return K.list_corrections(_proposed_corrections(spark, sf_dir), dataset="inventory")


@query(f"select p.dataset, p.column_name, p.original, i.severity from {_proposed} p left join {_all} i on i.dataset = p.dataset and i.column_name is not distinct from p.column_name and i.issue_type = case p.correction_type when 'normalize_date' then 'invalid_date' when 'normalize_currency' then 'invalid_currency' else 'invalid_reference' end")
def link_corrections(spark, sf_dir):
    """Q17."""
    return K.link_corrections(_proposed_corrections(spark, sf_dir), _issues(spark, sf_dir)[0]).select("dataset", "column_name", "original", "severity")


def _review_events(spark, sf_dir):
    """Every order as an item; its line items as review events, in order of their line."""
    li = B.table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    action = F.expr("case l_linenumber % 4 when 1 then 'approve' when 2 then 'apply' when 3 then 'reject' else 'bulk_approve' end")
    return li.select(F.col("l_orderkey").alias("item"), action.alias("action"), F.col("l_linenumber").cast("long").alias("seq"))


@query("""with recursive ev as (select item, action, row_number() over (partition by item order by seq) as n from (select distinct l_orderkey as item, case l_linenumber % 4 when 1 then 'approve' when 2 then 'apply' when 3 then 'reject' else 'bulk_approve' end as action, l_linenumber as seq from lineitem)),
fold(item, n, status) as (select o_orderkey, cast(0 as bigint), 'pending' from orders union all select f.item, e.n, case when e.action in ('approve', 'bulk_approve') and f.status = 'pending' then 'approved' when e.action = 'reject' and f.status in ('pending', 'approved') then 'rejected' when e.action = 'apply' and f.status = 'approved' then 'applied' else f.status end from fold f join ev e on e.item = f.item and e.n = f.n + 1)
select item, arg_max(status, n) as status from fold group by 1""")
def review_state(spark, sf_dir):
    """Q18."""
    items = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"))
    return K.review_state(items, _review_events(spark, sf_dir), "item")


_fixed = f"(select c.dataset, c.column_name, c.value as was, coalesce(p.corrected, c.value) as value from ({_c}) c left join (select dataset, column_name, lower(trim(original)) as norm, arg_max(corrected, (confidence, -rk)) as corrected from (select *, row_number() over (order by original) as rk from {_proposed}) group by 1, 2, 3) p on p.dataset = c.dataset and p.column_name = c.column_name and p.norm = lower(trim(c.value)))"


@query(f"select dataset, column_name, value, count(*) as n, count(*) filter (was is distinct from value) as changed from {_fixed} group by 1, 2, 3")
def apply_corrections(spark, sf_dir):
    """Q19, Q20: all proposals approved and applied to all cells; what stands there then."""
    out, _ = K.apply_corrections(_cells(spark, sf_dir), _proposed_corrections(spark, sf_dir))
    return out.groupBy("dataset", "column_name", "value").agg(F.count("*").alias("n"), F.count_if(~F.col("was").eqNullSafe(F.col("value"))).alias("changed"))


@query(f"select p.dataset, p.column_name, p.original, coalesce(h.n, 0) as affected_rows from {_proposed} p left join (select dataset, column_name, lower(trim(value)) as norm, count(*) as n from ({_c}) group by 1, 2, 3) h on h.dataset = p.dataset and h.column_name = p.column_name and h.norm = lower(trim(p.original))")
def correction_counts(spark, sf_dir):
    """Q19: rows that each correction affects."""
    _, hits = K.apply_corrections(_cells(spark, sf_dir), _proposed_corrections(spark, sf_dir))
    return hits.select("dataset", "column_name", "original", "affected_rows")


def _scores(spark, sf_dir, found=None):
    issues, columns, schemas = found or _issues(spark, sf_dir)
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(d).alias("dataset"), "row_count") for d, df in dirty(spark, sf_dir).items()]
    catalogue = spark.createDataFrame(SOURCES, "dataset string, source_type string").join(counts[0].union(counts[1]).union(counts[2]).union(counts[3]), "dataset")
    return Q.readiness(catalogue, columns, schemas, issues), issues


@query(f"select * from {_ready}")
def readiness(spark, sf_dir):
    """Q21, Q23: the score card."""
    return Q.list_readiness(_scores(spark, sf_dir)[0]).select("dataset", "source_type", "completeness", "validity", "consistency", "uniqueness", "overall", "issue_count", "critical_issue_count")


@query(f"""select dataset, case when advice = '' then case when completeness >= 0.95 and validity >= 0.95 and consistency >= 0.95 and uniqueness >= 0.95 then 'Dataset is ready, with high quality scores' else 'Continue monitoring data quality metrics' end else advice end as recommendations from
(select r.*, concat_ws('; ', case when completeness < 0.8 then 'Add missing required columns based on the canonical schema for this source type' end, case when validity < 0.8 and k.d > 0 then 'Normalize date formats to ISO 8601 (YYYY-MM-DD)' end, case when validity < 0.8 and k.c > 0 then 'Standardize currency codes to ISO 4217' end, case when validity < 0.8 and k.m > 0 then 'Review and fill missing required values' end,
case when consistency < 0.9 and k.r > 0 then 'Resolve entity reference mismatches by adding missing entities to the knowledge graph or correcting values' end, case when uniqueness < 0.95 then 'Review and remove duplicate rows to ensure data integrity' end, case when k.o > 0 then 'Investigate outlier values to determine if they are data entry errors' end, case when k.s > 0 then 'Align column data types with canonical schema expectations' end) as advice
from {_ready} r left join (select dataset, count(*) filter (issue_type = 'invalid_date') as d, count(*) filter (issue_type = 'invalid_currency') as c, count(*) filter (issue_type = 'missing_value') as m, count(*) filter (issue_type = 'invalid_reference') as r, count(*) filter (issue_type = 'outlier') as o, count(*) filter (issue_type = 'schema_mismatch') as s from {_all} group by 1) k on k.dataset = r.dataset)""")
def recommendations(spark, sf_dir):
    """Q22."""
    return _scores(spark, sf_dir)[0].select("dataset", F.array_join("recommendations", "; ").alias("recommendations"))


@query(f"select dataset, 'ok' as status, count(*) as row_count, count(*) filter (was is distinct from value) as changed from {_fixed} group by 1 union all select 'broken', 'failed', null, null")
def apply_all(spark, sf_dir):
    """Q20: every table's corrections in a run of its own; one whose column is missing fails alone."""
    from functools import reduce

    fixes = _proposed_corrections(spark, sf_dir)
    tables = {d: S.cells(df, d, rename=str) for d, df in dirty(spark, sf_dir).items()} | {"broken": spark.range(1)}
    done, log = K.apply_all(tables, fixes)
    changed = [df.agg(F.count_if(~F.col("was").eqNullSafe(F.col("value"))).alias("changed")).select(F.lit(n).alias("name"), "changed") for n, df in done.items()]
    return log.join(reduce(lambda a, b: a.union(b), changed), "name", "left").select(F.col("name").alias("dataset"), "status", "row_count", "changed")


_changes = "(select 'shipments' as dataset, case l_linenumber % 3 when 0 then 'flag' when 1 then 'remark' end as column_name, case when l_linenumber % 3 = 2 then 'duplicate' else 'missing_value' end as issue_type, case l_linenumber % 5 when 0 then 'open' when 1 then 'acknowledged' when 2 then 'resolved' when 3 then 'ignored' else 'done' end as status, l_orderkey * 100 + l_linenumber as seq from lineitem)"
_stated = f"(select i.*, coalesce(c.status, 'open') as status from {_all} i left join (select dataset, column_name, issue_type, arg_max(status, (seq, status)) as status from {_changes} where status in ('open', 'acknowledged', 'resolved', 'ignored') group by all) c on c.dataset = i.dataset and c.column_name is not distinct from i.column_name and c.issue_type = i.issue_type)"


def _stated_issues(spark, sf_dir, issues):
    """Issues with the status that changes, read from the line items, leave them in."""
    changes = B.table(spark, sf_dir, "lineitem").selectExpr(
        "'shipments' as dataset", "case l_linenumber % 3 when 0 then 'flag' when 1 then 'remark' end as column_name", "case when l_linenumber % 3 = 2 then 'duplicate' else 'missing_value' end as issue_type",
        "case l_linenumber % 5 when 0 then 'open' when 1 then 'acknowledged' when 2 then 'resolved' when 3 then 'ignored' else 'done' end as status", "l_orderkey * 100 + l_linenumber as seq",
    )
    return K.issue_status(issues, changes, ["dataset", "column_name", "issue_type"])


@query(f"select dataset, column_name, issue_type, severity, status from {_stated}")
def issue_status(spark, sf_dir):
    """Q18: issues with the last of four states that was set; other words count as nothing."""
    return _stated_issues(spark, sf_dir, _issues(spark, sf_dir)[0]).select("dataset", "column_name", "issue_type", "severity", "status")


_every = f"(select * from {_proposed} union all select dataset, column_name, 'remove_duplicate', null, null, cast(0.7 as double) from ({_dups}))"


@query(f"""with i as {_stated}, r as {_ready}, s as {_schemas}, p as (select *, row_number() over (order by dataset desc, column_name desc, original desc) as place from {_every})
select 'total' as metric, 'schemas' as key, cast(count(*) as double) as n from s union all select 'total', 'issues', count(*) from i union all select 'total', 'critical', count(*) filter (severity in ('critical', 'error')) from i union all select 'total', 'open', count(*) filter (status = 'open') from i
union all select 'total', 'corrections', count(*) from p union all select 'total', 'pending', count(*) from p union all select 'total', 'scored', count(*) from r
union all select 'issue_type', issue_type, count(*) from i group by 2 union all select 'severity', severity, count(*) from i group by 2 union all select 'issue_status', status, count(*) from i group by 2 union all select 'correction', 'pending', count(*) from p having count(*) > 0
union all select 'mean_score', 'all', round(avg(overall), 6) from r union all select 'below_0.7', 'all', count(*) filter (overall < 0.7) from r union all select 'attention', dataset, overall from r where overall < 0.7
union all select 'schema', concat_ws('/', source_type, role), round(frequency, 6) from s union all select 'issue', concat_ws('/', dataset, column_name, issue_type, severity, status), affected_rows from i
union all select 'latest_correction', concat_ws('/', dataset, column_name, correction_type, original, corrected), confidence from p where place <= 20""")
def quality_report(spark, sf_dir):
    """Q24, Q25: the whole report as metric, key and number; all proposals are pending, those to remove duplicates among them."""
    found = _issues(spark, sf_dir)
    scores, issues = _scores(spark, sf_dir, found)
    fixes = _proposed_corrections(spark, sf_dir).unionByName(K.propose_duplicate_removal(issues))
    fixes = scratch.stored(fixes, "corrections").withColumn("status", F.lit("pending")).withColumn("seq", F.struct("dataset", "column_name", "original"))
    stated = scratch.stored(_stated_issues(spark, sf_dir, issues), "stated")
    return Q.quality_report(stated, scratch.stored(scores.select("dataset", "overall"), "scores"), fixes, found[2]).withColumn("n", F.round("n", 6))


_advice = SQL["recommendations"]
_seq_i = f"(select *, row_number() over (order by dataset, issue_type, column_name nulls first) as seq from {_stated})"


@query(f"""with i as {_seq_i}, s as {_ready}, p as (select *, row_number() over (order by dataset desc, column_name desc, original desc) as place from {_proposed})
select 'summary' as section, 1 as place, cast(null as varchar) as dataset, 'issues' as detail, cast(count(*) as double) as value from i union all select 'summary', 2, null, 'critical', count(*) filter (severity in ('critical', 'error')) from i union all select 'summary', 3, null, 'open', count(*) filter (status = 'open') from i
union all select 'summary', 4, null, 'pending', count(*) from p union all select 'summary', 5, null, 'scored', count(*) from s union all select 'summary', 6, null, 'mean', round(avg(overall), 3) from s
union all select 'worst', row_number() over (order by s.overall, s.dataset), s.dataset, a.recommendations, s.overall from s join ({_advice}) a on a.dataset = s.dataset where s.overall < 0.7 qualify row_number() over (order by s.overall, s.dataset) <= 10
union all select 'issues', row_number() over (order by seq desc), dataset, concat_ws('/', column_name, issue_type, severity, status), affected_rows from i qualify row_number() over (order by seq desc) <= 20
union all select 'corrections', place, dataset, concat_ws('/', column_name, correction_type, original, corrected), confidence from p where place <= 20""")
def report_board(spark, sf_dir):
    """Q24, Q25: the whole report: counts, the ten worst tables, the latest issues and corrections."""
    scores, issues = _scores(spark, sf_dir)
    order = F.struct("dataset", "issue_type", F.coalesce("column_name", F.lit("")))
    corrections = scratch.stored(_proposed_corrections(spark, sf_dir), "corrections").withColumn("status", F.lit("pending")).withColumn("seq", F.struct("dataset", "column_name", "original"))
    return Q.report_board(_stated_issues(spark, sf_dir, issues).withColumn("seq", order), scores, corrections)


@query(f"select value, strftime(case when was is distinct from value or regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_cast(value as date) end, '%Y-%m-%d') as date_value, count(*) as n from {_fixed} where column_name = 'due_date' group by 1, 2")
def applied_dates(spark, sf_dir):
    """Q19: what date corrections leave in their cells, as text and as dates."""
    out, _ = K.apply_corrections(_column(spark, sf_dir, "schedule", "due_date"), _proposed_corrections(spark, sf_dir))
    return out.groupBy("value", F.date_format("date_value", "yyyy-MM-dd").alias("date_value")).agg(F.count("*").alias("n"))
