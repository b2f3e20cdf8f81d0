"""The output model: objects, relationships, source tables, summary, warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

LAYERS = ("cost_pool", "resource_tower", "solution")
READY = 0.7


def entity_sources(edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """id, sources: the sorted names of the tables that gave evidence for an edge at the entity. edges: from_id, to_id, dataset."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id"), "dataset").distinct()
    return ends.join(datasets.select("dataset", "file_name"), "dataset").groupBy("id").agg(F.array_sort(F.collect_set("file_name")).alias("sources"))


def best_classification(classes: DataFrame) -> DataFrame:
    """The most confident class per entity and layer; ties go to the smaller path."""
    w = Window.partitionBy("id", "layer").orderBy(F.desc("confidence"), "path")
    return classes.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")


def objects(nodes: DataFrame, classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Business entities with a column per layer. nodes: id, name, entity_type, alias_count."""
    best = best_classification(classes).withColumn("value", F.when(F.col("layer") == "cost_pool", F.col("level_1")).otherwise(F.coalesce("level_2", "level_1")))
    wide = best.groupBy("id").agg(*[F.max(F.when(F.col("layer") == layer, F.col("value"))).alias(layer) for layer in LAYERS], F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "path")))).alias("paths"), F.round(F.avg("confidence"), 3).alias("mapping_confidence"))
    own = nodes.filter(~F.col("entity_type").isin(*rules.INTERNAL_TYPES))
    return own.join(wide, "id", "left").join(sources, "id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def relationships(edges: DataFrame, nodes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Edges between business entities or tables, with the names of their ends and of the evidence.

    Nodes are hashed part by part and edges stream past them: many edges end at one node, and no task sorts or holds these.
    """
    group = nodes.filter("entity_type = 'attribute_group'").select("id")
    some = edges.filter("edge_type <> 'maps_to_category'")
    for end in ("from_id", "to_id"):
        some = some.join(group.withColumnRenamed("id", end).hint("shuffle_hash"), end, "left_anti")
    name = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("entity_type").alias(f"{s}_type")).hint("shuffle_hash")
    out = some.join(name("from"), "from_id").join(name("to"), "to_id").join(F.broadcast(datasets.select("dataset", F.col("file_name").alias("evidence"))), "dataset", "left")
    return out.select("from_id", "from_name", "from_type", F.coalesce("label", "edge_type").alias("relationship"), "to_id", "to_name", "to_type", "confidence", "evidence")


def source_datasets(datasets: DataFrame, readiness: DataFrame, ready: float = READY) -> DataFrame:
    out = datasets.join(readiness.select("dataset", F.col("overall").alias("readiness_score"), "issue_count", "critical_issue_count"), "dataset", "left")
    return out.withColumn("is_ready", F.coalesce(F.col("readiness_score") >= ready, F.lit(False)))


def model_summary(objs: DataFrame, rels: DataFrame, sources: DataFrame) -> DataFrame:
    """metric, key, value."""
    has = F.col("mapping_confidence").isNotNull()
    one = lambda df, metric, c: df.agg(c.cast("double").alias("value")).select(F.lit(metric).alias("metric"), F.lit("all").alias("key"), "value")
    by = lambda metric, col: objs.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    rows = [
        one(objs, "objects", F.count("*")), one(objs, "classified", F.count_if(has)), one(objs, "coverage", F.round(F.coalesce(F.avg(has.cast("int")), F.lit(0.0)), 3)),
        one(rels, "relationships", F.count("*")), one(sources, "datasets", F.count("*")), one(sources, "ready", F.count_if("is_ready")),
        one(sources, "mean_readiness", F.round(F.coalesce(F.avg("readiness_score"), F.lit(0.0)), 3)), one(objs, "mean_confidence", F.round(F.coalesce(F.avg("mapping_confidence"), F.lit(0.0)), 3)),
        by("type", "entity_type"), by("tower", "resource_tower"),
    ]
    return reduce(DataFrame.unionByName, rows)


def model_warnings(objs: DataFrame, rels: DataFrame, sources: DataFrame) -> DataFrame:
    """seq, warning: at most four, with the first five names of tables that aren't ready."""
    o = objs.agg(F.count("*").alias("n"), F.count_if(F.col("mapping_confidence").isNull()).alias("open"))
    r = rels.agg(F.count("*").alias("rels"))
    w = sources.filter("not is_ready").agg(F.count("*").alias("late"))
    names = sources.filter("not is_ready").orderBy("file_name").limit(5).agg(F.array_join(F.array_sort(F.collect_list("file_name")), ", ").alias("names"))
    c = F.col
    said = F.array(
        F.when(c("n") == 0, F.struct(F.lit(1).alias("seq"), F.lit("No business objects in the context graph — rebuild the graph first.").alias("warning"))),
        F.when(c("open") > 0, F.struct(F.lit(2).alias("seq"), F.format_string("%d of %d object(s) have no approved classification and stay unallocated. Approve more mappings to close the gap.", "open", "n").alias("warning"))),
        F.when(c("late") > 0, F.struct(F.lit(3).alias("seq"), F.concat(c("late").cast("string"), F.lit(f" source dataset(s) score below the {READY} readiness threshold: "), c("names"), F.when(c("late") > 5, ", …").otherwise(""), F.lit(".")).alias("warning"))),
        F.when((c("rels") == 0) & (c("n") > 0), F.struct(F.lit(4).alias("seq"), F.lit("No relationships were preserved — cost can't be allocated across these objects.").alias("warning"))),
    )
    return o.join(r, F.lit(True)).join(w, F.lit(True)).join(names, F.lit(True)).select(F.inline(F.filter(said, lambda x: x.isNotNull())))


def filter_objects(objs: DataFrame, entity_type: str) -> DataFrame:
    return objs.filter(F.col("entity_type") == entity_type)


def sheet_rows(objs: DataFrame) -> DataFrame:
    """Objects as they are exported: a table name per type, nulls as empty texts, tables joined by semicolons."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    title = F.substring(F.concat(F.initcap(F.replace("entity_type", F.lit("_"), F.lit(" "))), F.lit("s")), 1, 31)
    return objs.select(title.alias("sheet"), "id", "name", *[blank(c) for c in (*LAYERS, "mapping_confidence")], "alias_count", F.array_join("sources", "; ").alias("sources"))


def export_model(objs: DataFrame, rels: DataFrame, sources: DataFrame, summary: DataFrame, base: str) -> None:
    """One folder per object type, and three tables beside them."""
    sheet_rows(objs).write.partitionBy("sheet").parquet(f"{base}/objects")
    rels.write.parquet(f"{base}/relationships")
    sources.withColumn("is_ready", F.when(F.col("is_ready"), "yes").otherwise("no")).write.parquet(f"{base}/source_datasets")
    summary.write.parquet(f"{base}/summary")


def cost_by(facts: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Cost by each prefix of the keys, and in all. Not in the reference's code; an extension."""
    return facts.rollup(*keys).agg(F.sum(amount).alias("cost"), F.count("*").alias("n"))


def month_over_month(facts: DataFrame, key: str, when: str, amount: str) -> DataFrame:
    """Cost per month and its change from the month before that has any. An extension."""
    m = facts.groupBy(key, F.trunc(when, "month").alias("month")).agg(F.sum(amount).alias("cost"))
    return m.withColumn("change", F.col("cost") - F.lag("cost").over(Window.partitionBy(key).orderBy("month")))


def _monthly(facts: DataFrame, keys: list[str], when: str, amount: str) -> DataFrame:
    """keys, month_no (months since year 0), cost."""
    month_no = (F.year(when) * 12 + F.month(when) - 1).cast("long")
    return facts.filter(F.col(when).isNotNull()).groupBy(*keys, month_no.alias("month_no")).agg(F.sum(amount).alias("cost"))


def cost_spikes(facts: DataFrame, keys: list[str], when: str, amount: str, months: int = 6, sigmas: float = 2.0, least: int = 3) -> DataFrame:
    """keys, month_no, cost, mean, deviation, known, gap, is_spike: each month against the months before it. An extension.

    The frame is a range of calendar months that ends before the current one: months without cost are gaps in it, not rows, so `known` tells how many it holds and gap how many
    months lie empty just before. A spike exceeds the mean by so many deviations, where `least` months are known.
    """
    before = Window.partitionBy(*keys).orderBy("month_no").rangeBetween(-months, -1)
    out = _monthly(facts, keys, when, amount).select("*", F.avg("cost").over(before).alias("mean"), F.stddev_pop("cost").over(before).alias("deviation"), F.count("cost").over(before).alias("known"), (F.col("month_no") - F.lag("month_no").over(Window.partitionBy(*keys).orderBy("month_no")) - 1).alias("gap"))
    return out.withColumn("is_spike", (F.col("known") >= least) & F.coalesce(F.col("cost") > F.col("mean") + sigmas * F.col("deviation"), F.lit(False)))


def new_services(facts: DataFrame, service: str, when: str, amount: str, months: int = 3) -> DataFrame:
    """service, first_month_no, first_cost, early_cost (of its first `months` calendar months), months_seen, is_new: whether it first appeared in the last `months` months of all. An extension."""
    m = _monthly(facts, [service], when, amount)
    own = Window.partitionBy(service).orderBy("month_no")
    first = m.withColumn("early", F.sum("cost").over(own.rangeBetween(0, months - 1)))
    by = first.groupBy(service).agg(F.min("month_no").alias("first_month_no"), F.min_by("cost", "month_no").alias("first_cost"), F.min_by("early", "month_no").alias("early_cost"), F.count("*").alias("months_seen"))
    last = m.agg(F.max("month_no").alias("last"))
    return by.join(F.broadcast(last), F.lit(True)).withColumn("is_new", F.col("first_month_no") > F.col("last") - months).drop("last")
