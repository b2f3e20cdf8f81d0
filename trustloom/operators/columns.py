"""What columns mean, and how columns of different tables relate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources.tables import upsert


def classify_columns(profile: DataFrame, patterns=rules.ROLE_PATTERNS) -> DataFrame:
    """role, role_confidence, is_technical from names and samples. A column without samples counts as all-UUID."""
    name = F.lower("column_name")
    uuids = F.forall(F.coalesce("samples", F.array().cast("array<string>")), lambda v: F.lower(v).rlike(rules.UUID_VALUE))
    technical = name.rlike(rules.TECHNICAL_NAME) | uuids | name.rlike(rules.TIMESTAMP_NAME)
    role = text.first_match(F.col("column_name"), patterns, F.lit("other"))
    out = profile.withColumn("is_technical", technical).withColumn("role", F.when(F.col("is_technical"), "identifier").otherwise(role))
    return out.withColumn("role_confidence", F.when(F.col("is_technical"), 0.9).when(F.col("role") == "other", 0.3).otherwise(0.65))


def override_roles(classified: DataFrame, overrides: dict[str, tuple[str, ...]] = rules.ROLE_OVERRIDES) -> DataFrame:
    """Names that are certain, over any classifier; a plus sign marks a joined label, which is a description."""
    spark = classified.sparkSession
    table = spark.createDataFrame([(n, r) for r, names in overrides.items() for n in names], "norm string, sure string")
    out = classified.withColumn("norm", F.regexp_replace(F.lower("column_name"), r"[\s_-]", "")).join(F.broadcast(table), "norm", "left")
    sure = F.when(F.col("column_name").contains("+"), F.lit("description")).otherwise(F.col("sure"))
    out = out.withColumn("sure", sure)
    return out.withColumns({"role": F.coalesce("sure", "role"), "role_confidence": F.when(F.col("sure").isNotNull(), 1.0).otherwise(F.col("role_confidence")), "is_technical": F.when(F.col("sure").isNotNull(), F.col("sure") == "identifier").otherwise(F.col("is_technical"))}).drop("norm", "sure")


def apply_role_verdicts(classified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outside roles by (dataset, column_name); an unknown role is other, a missing confidence 0.5, a missing column keeps its own."""
    v = verdicts.select("dataset", "column_name", F.when(F.col("role").isin(*rules.ROLES), F.col("role")).otherwise("other").alias("v_role"), F.coalesce("role_confidence", F.lit(0.5)).alias("v_conf"), F.coalesce("is_technical", F.lit(False)).alias("v_tech"))
    both = classified.join(v, ["dataset", "column_name"], "left")
    return both.withColumns({"role": F.coalesce("v_role", "role"), "role_confidence": F.coalesce("v_conf", "role_confidence"), "is_technical": F.coalesce("v_tech", "is_technical")}).drop("v_role", "v_conf", "v_tech")


def describe_purpose(columns: DataFrame, sources: DataFrame) -> DataFrame:
    n = columns.groupBy("dataset").agg(F.count("*").alias("n"))
    return n.join(sources, "dataset").select("dataset", F.format_string("%s dataset with %d columns", "source_type", "n").alias("business_purpose"))


def detect_relationships(columns: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Column pairs of different tables by name, shared samples and role; from is the later table by name.

    columns: dataset, column_name, role, is_technical, samples. Names may hold one another, so this is a theta join; its sides have a
    row per catalogued column, whatever the tables' sizes.
    """
    some = columns.filter(~F.col("is_technical") & ~F.col("role").isin(*rules.UNRELATABLE_ROLES)).select("dataset", "column_name", "role", "samples")
    a, b = (some.select(*[F.col(c).alias(f"{s}_{c}") for c in some.columns]) for s in ("from", "to"))
    pairs = a.join(b, F.col("from_dataset") > F.col("to_dataset"))
    sim, over = text.name_similarity(F.col("from_column_name"), F.col("to_column_name")), text.value_overlap(F.col("from_samples"), F.col("to_samples"))
    scored = pairs.withColumn("name_sim", sim).withColumn("overlap", over).withColumn("same_role", F.col("from_role") == F.col("to_role"))
    scored = scored.withColumn("confidence", F.least(0.5 * F.col("name_sim") + 0.4 * F.col("overlap") + F.when(F.col("same_role"), 0.2).otherwise(0.0), F.lit(0.98)))
    reasons = F.concat_ws("; ", F.when(F.col("name_sim") > 0, "similar column names"), F.when(F.col("overlap") > 0, "overlapping values"), F.when(F.col("same_role"), "same semantic role"))
    kind = F.when(F.col("overlap") >= 0.5, "value_overlap").otherwise("name_similarity")
    return scored.filter(F.col("confidence") >= threshold).select("from_dataset", "from_column_name", "to_dataset", "to_column_name", kind.alias("relationship_type"), "confidence", reasons.alias("reasoning"))


def list_relationships(relationships: DataFrame, dataset: str) -> DataFrame:
    return relationships.filter((F.col("from_dataset") == dataset) | (F.col("to_dataset") == dataset)).orderBy(F.desc("confidence"))


def update_columns(columns: DataFrame, updates: DataFrame) -> DataFrame:
    """The catalogue's columns with what updates say of them (dataset, column_name and any of role, role_confidence, is_technical)."""
    return upsert(columns, updates.join(columns.select("dataset", "column_name"), ["dataset", "column_name"], "left_semi"), ["dataset", "column_name"])


def pair_id_columns(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns to embed, pairs id_column/name_column): per table and role, IDs beside exactly one name become its property."""
    w = Window.partitionBy("dataset", "role")
    pairable = F.col("role").isin(*rules.PAIRABLE_ROLES)
    c = columns.withColumn("by_name", text.is_id_name(F.col("column_name"))).withColumn("code", text.looks_like_code(F.col("samples")))
    c = c.withColumns({"ids": F.count_if("by_name").over(w), "names": F.count_if(~F.col("by_name")).over(w), "codes": F.count_if(~F.col("by_name") & F.col("code")).over(w)})
    # two names and no ID: the one whose values look like codes is the ID, if it is the only one
    tie = (F.col("ids") == 0) & (F.col("names") == 2) & (F.col("codes") == 1)
    plain = (F.col("ids") > 0) & (F.col("names") == 1)
    c = c.withColumn("is_id", F.when(pairable & plain, F.col("by_name")).when(pairable & tie, F.col("code")).otherwise(False)).withColumn("pairs", pairable & (plain | tie))
    rest = c.filter("not is_id").select(*columns.columns)
    named = c.filter("pairs and not is_id").select("dataset", "role", F.col("column_name").alias("name_column"))
    return rest, c.filter("is_id").select("dataset", "role", F.col("column_name").alias("id_column")).join(named, ["dataset", "role"])


def embeddable_columns(columns: DataFrame) -> DataFrame:
    return columns.filter(~F.col("is_technical") & F.col("role").isin(*rules.EMBEDDABLE_ROLES))
