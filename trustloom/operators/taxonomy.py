"""Mapping of row contexts to a taxonomy: retrieve, re-rank, decide, review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import scratch
from ..sources import tables as S
from .corrections import review_state

TRANSITIONS = {"approve": (("suggested", "unresolved", "approved", "rejected"), "approved"), "reject": (("suggested", "unresolved", "approved"), "rejected"), "override": (("suggested", "unresolved", "approved", "rejected"), "overridden")}


def useful_columns(columns: DataFrame, layer: str) -> DataFrame:
    hint = F.lower("column_name").rlike(rules.USEFUL_NAME)
    return columns.filter(~F.col("is_technical") & (F.col("role").isin(*rules.LAYER_ROLES[layer]) | hint))


def anchor_rank(role: Column) -> Column:
    """Place of a role in the anchor order, 100 if it has none."""
    at = F.array_position(F.array(*[F.lit(r) for r in rules.ANCHOR_ORDER]), F.coalesce(role, F.lit(""))).cast("int")
    return F.when(at > 0, at - 1).otherwise(100)


def row_context(df: DataFrame, roles: dict[str, str], row: Column, source_type: str | None = None, purpose: str | None = None) -> DataFrame:
    """row_no, anchor_column, anchor_value, context_text, context: from the useful columns of a wide table, in anchor order.

    The order is known before any row is read, so a row's context is an expression of the row: nothing is shuffled.
    """
    spot = {r: i for i, r in enumerate(rules.ANCHOR_ORDER)}
    order = sorted(roles, key=lambda c: (spot.get(roles[c], 100), df.columns.index(c)))
    cell = lambda c: text.trimmed(F.col(c).cast("string"))
    ok = lambda c: (cell(c) != "") & (F.length(cell(c)) <= 500)
    parts = F.array(*[F.when(ok(c), F.struct(F.lit(c).alias("c"), cell(c).alias("v"))) for c in order])
    rows = df.select(row.alias("row_no"), F.filter(parts, lambda x: x.isNotNull()).alias("p")).filter(F.size("p") > 0)
    head = [F.lit(f"Dataset type: {source_type}")] if source_type else []
    head += [F.lit(f"Purpose: {purpose}")] if purpose else []
    line = F.array_join(F.concat(F.array(*head).cast("array<string>"), F.transform("p", lambda x: F.concat(x["c"], F.lit(": "), x["v"]))), ". ")
    first = F.col("p")[0]
    return rows.select("row_no", first["c"].alias("anchor_column"), first["v"].alias("anchor_value"), line.alias("context_text"), F.map_from_entries("p").alias("context"))


def dedupe_context(contexts: DataFrame, limit: int | None = 150) -> DataFrame:
    """One context per (dataset, if there is such a column, anchor column, lower-case value): the first row's text, and how many rows there are. limit: contexts kept of each dataset, by first row."""
    by = ["dataset"] if "dataset" in contexts.columns else []
    out = contexts.groupBy(*by, "anchor_column", F.lower("anchor_value").alias("anchor_key")).agg(F.min(F.struct("row_no", "anchor_value", "context_text")).alias("f"), F.count("*").alias("occurrences"))
    out = out.select(*by, "anchor_column", "anchor_key", F.col("f.anchor_value").alias("anchor_value"), F.col("f.context_text").alias("context_text"), "occurrences", F.col("f.row_no").alias("first_row"))
    if limit is None or not by:
        return out if limit is None else out.orderBy("first_row", "anchor_column", "anchor_key").limit(limit)
    first = Window.partitionBy(*by).orderBy("first_row", "anchor_column", "anchor_key")
    return out.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= limit).drop("_at")


def resolve_anchor(contexts: DataFrame, aliases: DataFrame) -> DataFrame:
    """With entity and canonical_name where the anchor is a known alias, which the context then names. aliases: anchor_column, anchor_key, entity, canonical_name."""
    out = contexts.join(aliases, ["anchor_column", "anchor_key"], "left")
    named = F.concat(F.col("context_text"), F.lit(". Canonical entity: "), F.col("canonical_name"))
    return out.withColumn("context_text", F.coalesce(named, "context_text"))


def rank_candidates(contexts: DataFrame, distances: DataFrame, taxonomy: DataFrame, top: int = 20, weights=(0.6, 0.2, 0.2)) -> DataFrame:
    """id, category, score, rank: the nearest `top` of each context, scored by vectors, words and rules.

    distances: id, category, distance. taxonomy: category, layer, path, search_text.
    """
    w = Window.partitionBy("id").orderBy("distance", "category")
    near = distances.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= top).drop("_at")
    both = near.join(contexts.select("id", "context_text"), "id").join(taxonomy, "category")
    lexical = text.lexical_score(F.col("context_text"), F.col("path"), F.col("search_text"))
    both = both.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance"))).withColumn("lexical", lexical)
    both = both.withColumn("rule", text.rule_label(F.col("context_text"), F.col("path"), F.col("layer")))
    score = F.round(weights[0] * F.col("similarity") + weights[1] * F.col("lexical") + weights[2] * F.when(F.col("rule").isNotNull(), 1.0).otherwise(0.0), 3)
    both = both.withColumn("score", score)
    order = Window.partitionBy("id").orderBy(F.desc("score"), "distance", "category")
    return both.withColumn("rank", F.row_number().over(order)).select("id", "category", "path", "distance", "similarity", "lexical", "rule", "score", "rank")


def apply_mapping_verdicts(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """An outside choice among the five best: choice (from 1), confidence (0.5 if missing). Adds chosen and final."""
    v = verdicts.select("id", F.col("choice"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).alias("v_conf"))
    both = ranked.join(v, "id", "left")
    asked = F.col("choice").between(1, 5)
    return both.withColumn("chosen", F.col("rank") == F.when(asked, F.col("choice")).otherwise(1)).withColumn("final", F.when(asked, F.round(0.65 * F.col("score") + 0.35 * F.col("v_conf"), 3)).otherwise(F.col("score"))).withColumn("method", F.when(asked, "hybrid_llm").otherwise("hybrid")).drop("choice", "v_conf")


def decide_mapping(ranked: DataFrame, least: float = 0.35, sure: float = 0.85) -> DataFrame:
    """id, category, status, confidence, method, reasoning, alternatives. ranked may carry chosen, final and method."""
    has = "chosen" in ranked.columns
    r = ranked if has else ranked.withColumn("chosen", F.col("rank") == 1).withColumn("final", F.col("score")).withColumn("method", F.lit("hybrid"))
    pack = F.struct("category", "path", "score", "final", "similarity", "lexical", "rule", "method")
    out = r.groupBy("id").agg(F.max(F.when(F.col("chosen"), pack)).alias("b"), F.array_sort(F.collect_list(F.struct("rank", "category", "path", "score"))).alias("all"))
    weak = F.col("b.score") < least
    status = F.when(weak, "unresolved").when(F.col("b.final") >= sure, "approved").otherwise("suggested")
    share = lambda c: F.round(100 * F.col(c)).cast("int").cast("string")
    why = F.concat(F.lit("Selected from contextual similarity ("), share("b.similarity"), F.lit("%), keyword evidence ("), share("b.lexical"), F.lit("%)"), F.coalesce(F.concat(F.lit(", and a "), F.col("b.rule"), F.lit(" rule")), F.lit("")), F.lit("."))
    rest = F.when(weak, F.col("all")).otherwise(F.filter("all", lambda x: x["category"] != F.col("b.category")))
    return out.select("id", F.when(~weak, F.col("b.category")).alias("category"), F.when(~weak, F.col("b.path")).alias("path"), status.alias("status"), F.when(weak, F.col("b.score")).otherwise(F.col("b.final")).alias("confidence"), F.when(weak, "unresolved").otherwise(F.col("b.method")).alias("method"), F.when(weak, "No taxonomy candidate reached the minimum confidence threshold.").otherwise(why).alias("reasoning"), rest.alias("alternatives"))


def run_mapping(inputs: DataFrame, distances: DataFrame, taxonomy: DataFrame, verdicts: DataFrame | None = None, fallback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The chain for one layer: (mappings, counts as metric, n).

    inputs: id, context_text, canonical_name (null if the anchor is no known entity). distances: id, category, distance. fallback: the ids whose vectors
    are hashes. Contexts with no candidate are skipped.
    """
    ranked = rank_candidates(inputs, distances, taxonomy)
    mappings = scratch.stored(decide_mapping(ranked if verdicts is None else apply_mapping_verdicts(ranked, verdicts)), "mappings")
    own = inputs.select("id", F.col("canonical_name").isNotNull().alias("linked")).join(mappings.select("id", "category", "status"), "id", "left")
    weak = fallback.select("id", F.lit(True).alias("weak")).distinct() if fallback is not None else inputs.select("id").limit(0).withColumn("weak", F.lit(True))
    c = F.col
    tests = {
        "candidates": F.lit(True), "mapped": c("category").isNotNull(), "auto": c("status") == "approved", "review": c("status") == "suggested",
        "unresolved": c("status") == "unresolved", "linked": c("linked"), "skipped": c("status").isNull(), "fallback": c("weak").isNotNull(),
    }
    wide = own.join(weak, "id", "left").agg(*[F.count_if(x).alias(k) for k, x in tests.items()])
    return mappings, wide.unpivot([], list(tests), "metric", "n")


def upsert_mappings(existing: DataFrame, incoming: DataFrame, replace: bool = False) -> DataFrame:
    """Fresh mappings over old ones; an approved or overridden status stays unless replace."""
    keep = F.when(F.col("old.status").isin("approved", "overridden") & F.lit(not replace), F.col("old.status")).otherwise(F.coalesce("new.status", "old.status"))
    return S.upsert(existing, incoming, ["id"], {"status": keep})


def list_mappings(mappings: DataFrame, status: str | None = None) -> DataFrame:
    some = mappings if status is None else mappings.filter(F.col("status") == status)
    return some.orderBy(F.desc("confidence"), "id")


def mapping_list(mappings: DataFrame, datasets: DataFrame, columns: DataFrame, taxonomy: DataFrame, **filters) -> DataFrame:
    """Mappings with what they are about, the most confident first: file_name of their dataset, role of their column, and the category's layer and path (null where none was found).

    mappings: dataset, column_name, value, category, status, confidence. datasets: dataset, file_name. columns: dataset, column_name, role. taxonomy: category, layer, path. filters: column = value.
    """
    out = mappings.drop("path").join(datasets.select("dataset", "file_name"), "dataset").join(columns.select("dataset", "column_name", "role"), ["dataset", "column_name"]).join(taxonomy.select("category", "layer", "path"), "category", "left")
    for c, v in filters.items():
        out = out.filter(F.col(c) == v)
    return out.orderBy(F.desc("confidence"), "file_name", "value")


def approved_mappings(mappings: DataFrame, taxonomy: DataFrame, datasets: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity, category, layer, path, file_name, value, confidence of approved and overridden mappings, for every entity that the value is an alias of.

    aliases: dataset, column_name, value, entity; they meet by dataset, column and the value in lower case.
    """
    good = mappings.drop("path").filter(F.col("status").isin("approved", "overridden")).withColumn("_key", F.lower("value"))
    known = aliases.select("dataset", "column_name", F.lower("value").alias("_key"), "entity").distinct()
    out = good.join(taxonomy.select("category", "layer", "path"), "category").join(datasets.select("dataset", "file_name"), "dataset").join(known, ["dataset", "column_name", "_key"])
    return out.select("entity", "category", "layer", "path", "file_name", "value", "confidence")


def review_mappings(mappings: DataFrame, events: DataFrame) -> DataFrame:
    """Mappings after review. events: id, action, seq, category (for an override, which is certain); with reviewer and at, the last event's are kept as reviewed_by and reviewed_at."""
    log = events.join(mappings.select("id", F.col("status").alias("start")), "id")
    state = review_state(mappings, events, "id", {k: (tuple({*v[0], "pending"}), v[1]) for k, v in TRANSITIONS.items()})
    last = log.filter("action = 'override'").groupBy("id").agg(F.max_by("category", "seq").alias("new"))
    out = mappings.join(state.withColumnRenamed("status", "folded"), "id", "left").join(last, "id", "left")
    if "reviewer" in events.columns:
        out = out.join(events.groupBy("id").agg(F.max_by("reviewer", "seq").alias("reviewed_by"), F.max_by("at", "seq").alias("reviewed_at")), "id", "left")
    over = F.col("folded") == "overridden"
    return out.withColumns({"status": F.when(F.col("folded") == "pending", F.col("status")).otherwise(F.coalesce("folded", "status")), "category": F.when(over, F.coalesce("new", "category")).otherwise(F.col("category")), "confidence": F.when(over, 1.0).otherwise(F.col("confidence")), "method": F.when(over, "manual_override").otherwise(F.col("method"))}).drop("folded", "new")


def category_edges(mappings: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity -> category path edges of approved and overridden mappings, the most confident per pair. A view: nothing to undo. aliases: id, entity."""
    good = mappings.filter(F.col("status").isin("approved", "overridden") & F.col("path").isNotNull())
    return good.join(aliases, "id").groupBy("entity", "path").agg(F.max("confidence").alias("confidence"), F.count("*").alias("mappings"))


def mapping_report(mappings: DataFrame) -> DataFrame:
    """metric, key, n: total, classified, coverage, mean confidence, by status, by second level."""
    good = F.col("category").isNotNull()
    one = lambda name, c: mappings.agg(c.cast("double").alias("n")).select(F.lit(name).alias("metric"), F.lit("all").alias("key"), "n")
    by = mappings.groupBy(F.col("status").alias("key")).agg(F.count("*").cast("double").alias("n")).select(F.lit("status").alias("metric"), "key", "n")
    level = mappings.filter(good).groupBy(F.split_part("path", F.lit(" > "), F.lit(2)).alias("key")).agg(F.count("*").cast("double").alias("n")).select(F.lit("level_2").alias("metric"), "key", "n")
    return reduce(DataFrame.unionByName, [one("total", F.count("*")), one("classified", F.count_if(good)), one("coverage", F.avg(good.cast("int"))), one("mean_confidence", F.avg("confidence")), by, level])
