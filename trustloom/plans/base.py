"""The driver's tables as a catalogue of datasets, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import tables as S

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Columns and types of the star tables, for the SQL twins.
COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:long s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:long p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:timestamp o_orderpriority:string",
    "lineitem": "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp",
    "events": "event_id:long ts:timestamp user_id:long event_type:string value:double props:string",
}
#: What the columns stand for; the driver's headers carry no business words.
ROLE_TABLE = (
    ("supplier", "name", "vendor"), ("supplier", "suppkey", "vendor"), ("part", "brand", "application"), ("part", "name", "service"), ("part", "type", "cloud_resource"),
    ("nation", "name", "business_unit"), ("region", "name", "department"), ("customer", "mktsegment", "cost_center"), ("orders", "orderpriority", "project"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star(spark: SparkSession, sf_dir: str, names=STAR) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def cells(spark: SparkSession, sf_dir: str, names=STAR) -> DataFrame:
    return S.all_cells(star(spark, sf_dir, names))


def profile(spark: SparkSession, sf_dir: str, names=STAR) -> DataFrame:
    return P.profile_tables(star(spark, sf_dir, names))


def headers(spark: SparkSession, sf_dir: str, names=STAR) -> DataFrame:
    """dataset, column_name, ordinal, from the tables' own schemas: no data is read for them."""
    rows = [(n, S.strip_prefix(c), i) for n, df in star(spark, sf_dir, names).items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "dataset string, column_name string, ordinal int")


def row_counts(spark: SparkSession, sf_dir: str, names=STAR) -> DataFrame:
    """dataset, row_count, from the files' footers."""
    frames = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("dataset"), "row_count") for n, df in star(spark, sf_dir, names).items()]
    return reduce(DataFrame.unionByName, frames)


def role_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLE_TABLE, "dataset string, column_name string, role string")


def with_roles(profile: DataFrame) -> DataFrame:
    """A profile with the role table's roles: what it names is certain, keys are technical, the rest is other."""
    known = profile.join(F.broadcast(role_table(profile.sparkSession)), ["dataset", "column_name"], "left")
    tech = F.col("role").isNull() & F.col("column_name").rlike("(key|_id)$")
    return known.withColumn("is_technical", tech).withColumn("role", F.when(tech, "identifier").otherwise(F.coalesce("role", F.lit("other")))).withColumn("role_confidence", F.lit(1.0))


# --- SQL twins ---------------------------------------------------------------------------------------------


def sql_text(column: str, kind: str) -> str:
    if kind == "double":
        return f"cast(cast({column} as decimal(38,6)) as varchar)"
    if kind == "timestamp":
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"cast({column} as varchar)"


def sql_cells(names=STAR) -> str:
    """dataset, column_name, ordinal, value as a SELECT."""
    parts = []
    for n in names:
        for i, c in enumerate(COLUMNS[n].split()):
            name, kind = c.split(":")
            parts.append(f"select '{n}' as dataset, '{S.strip_prefix(name)}' as column_name, {i} as ordinal, {sql_text(name, kind)} as value from {n}")
    return " union all ".join(parts)


def sql_counts(names=STAR) -> str:
    return " union all ".join(f"select '{n}' as dataset, count(*) as row_count from {n}" for n in names)


def sql_values(rows) -> str:
    quote = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "values " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def sql_roles() -> str:
    return f"(select * from ({sql_values(ROLE_TABLE)}) as r(dataset, column_name, role))"


def sql_columns(names=STAR) -> str:
    rows = [(n, S.strip_prefix(c.split(":")[0]), i) for n in names for i, c in enumerate(COLUMNS[n].split())]
    return f"(select * from ({sql_values(rows)}) as c(dataset, column_name, ordinal))"


SQL_DATE = "coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%Y-%m-%d %H:%M:%S'), try_strptime(value, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(value, '%m/%d/%Y'), try_strptime(value, '%Y/%m/%d'))"


def sql_profile(names=STAR) -> str:
    """The profile as a SELECT; samples joined by a bar."""
    return f"""
    with cells as ({sql_cells(names)}),
    vals as (select dataset, column_name, ordinal, value, count(*) as n, (value is null or value = '') as empty,
             case when value is null or value = '' then true else {SQL_DATE} is not null and length(value) >= 8 end as d,
             case when value is null or value = '' then true else try_cast(value as double) is not null end as num
             from cells group by all),
    s as (select dataset, column_name, string_agg(value, '|' order by value) as samples from
          (select *, row_number() over (partition by dataset, column_name order by value) as rn from vals where not empty) where rn <= 5 group by all)
    select v.dataset, v.column_name, v.ordinal, cast(sum(n) as bigint) as row_count, cast(sum(case when empty then n else 0 end) as bigint) as nulls,
           count(*) as distinct_count,
           case when count(*) filter (not empty) = 0 then 'unknown' when bool_and(d) then 'date' when bool_and(num) then 'number' else 'string' end as inferred_type,
           count(*) = sum(n) as is_key, s.samples
    from vals v left join s on s.dataset = v.dataset and s.column_name = v.column_name group by v.dataset, v.column_name, v.ordinal, s.samples"""
