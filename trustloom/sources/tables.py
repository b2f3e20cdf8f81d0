"""Tables in, tables out: readers, the cell table, and the keyed updates that a catalogue needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """A table by path; the format from the ending if it isn't given. Headers are trimmed, blank texts become null."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    defaults = {"csv": {"header": True}, "tsv": {"header": True, "sep": "\t"}}.get(fmt, {})
    df = spark.read.format({"tsv": "csv"}.get(fmt, fmt)).options(**(defaults | options)).load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[F.when(F.trim(c) != "", F.col(f"`{c}`")).alias(c) if t == "string" and fmt in ("csv", "tsv") else F.col(f"`{c}`") for c, t in df.dtypes])


def as_text(c: Column, kind: T.DataType) -> Column:
    """One text form for each type: doubles with six places, timestamps with microseconds, numbers and texts as they are."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        fits = ~F.isnan(c) & (F.abs(c) < 1e31)  # what no decimal holds is written as it is
        return F.when(c.isNull() | fits, c.cast("decimal(38,6)").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def is_atomic(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def strip_prefix(name: str) -> str:
    """A column name without a one-letter table prefix."""
    return name[2:] if len(name) > 2 and name[1] == "_" else name


def cells(df: DataFrame, dataset: str, row: Column | None = None, rename=strip_prefix) -> DataFrame:
    """dataset, row_no, column_name, ordinal, value, native_type: one row per cell of an atomic column.

    row gives the row number (or key); without it rows are numbered as they are read, which is unique but has gaps.
    """
    fields = [f for f in df.schema.fields if is_atomic(f.dataType)]
    entries = F.array(*[F.struct(F.lit(rename(f.name)).alias("column_name"), F.lit(i).alias("ordinal"), as_text(F.col(f"`{f.name}`"), f.dataType).alias("value"), F.lit(f.dataType.simpleString()).alias("native_type")) for i, f in enumerate(fields)])
    numbered = df.select((row if row is not None else F.monotonically_increasing_id()).alias("row_no"), entries.alias("e"))
    return numbered.select(F.lit(dataset).alias("dataset"), "row_no", F.inline("e"))


def all_cells(tables: dict[str, DataFrame]) -> DataFrame:
    frames = [cells(df, name) for name, df in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ingest_batch(spark: SparkSession, paths: list[str], work, at_once: int = 4, deadline: float | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """work(path, table) for each path, several at once; a table that fails or takes too long doesn't stop the others. Results by path, and a row per run."""
    from . import runs

    return runs.run_all(spark, {p: (lambda p=p: work(p, read_table(spark, p))) for p in paths}, at_once, deadline)


def latest_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key: the current state of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows of existing with those of incoming over them. keep: for a column, the expression over `old` and `new` that decides.

    Of incoming rows with one key the largest counts, by its other columns in their order: the same one in every run.
    """
    others = [c for c in incoming.columns if c not in keys]
    if others:
        incoming = incoming.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])
    rest = [c for c in existing.columns if c not in keys]
    old, new = existing.withColumn("_old", F.lit(True)).alias("old"), incoming.dropDuplicates(keys).withColumn("_new", F.lit(True)).alias("new")
    both = old.join(new, keys, "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in incoming.columns else F.col(f"old.{c}")
    return both.select(*keys, *[(keep or {}).get(c, pick(c)).alias(c) for c in rest])


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Edges with the same ends and type become one: weights add up, the highest confidence counts, the last label stays."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("from_id", "to_id", "edge_type").agg(F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"), F.max_by("label", "seq").alias("label"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist and differ."""
    ids = nodes.select("id").distinct()
    some = edges.filter("from_id <> to_id")
    return some.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def write_corrected_copy(df: DataFrame, base: str, stamp: str) -> str:
    """Never over the source: to a new place that carries a time stamp."""
    to = f"{base.rstrip('/')}_corrected_{stamp}"
    df.write.mode("errorifexists").parquet(to)
    return to


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of primary, and for keys that it lacks those of fallback; source_kind tells which."""
    missing = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("source_kind", F.lit("rows")).unionByName(missing.withColumn("source_kind", F.lit("fallback")))


def load_taxonomy(items: DataFrame, layer: str, retired: str = "retired") -> DataFrame:
    """Uniform taxonomy rows from level_1..level_3, a description and a retired flag; rows without two levels go."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    some = items.withColumns({c: blank(F.col(c)) for c in ("level_1", "level_2", "level_3", "description")}).filter("level_1 is not null and level_2 is not null")
    levels = ("level_1", "level_2", "level_3")
    return some.select(F.lit(layer).alias("layer"), *levels, "description", (F.lower(F.coalesce(F.col(retired), F.lit(""))) == "yes").alias("is_retired"), F.concat_ws(" > ", *levels).alias("path"), F.concat_ws(". ", *levels, "description").alias("search_text"))


def list_taxonomy(items: DataFrame, layer: str | None = None, with_retired: bool = False) -> DataFrame:
    some = items if with_retired else items.filter("not is_retired")
    return (some if layer is None else some.filter(F.col("layer") == layer)).orderBy("layer", "level_1", "level_2", "level_3")
