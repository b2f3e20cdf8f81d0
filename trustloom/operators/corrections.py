"""Proposals, their review, and their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text

#: Which states a review event may follow.
TRANSITIONS = {"approve": (("pending",), "approved"), "reject": (("pending", "approved"), "rejected"), "bulk_approve": (("pending",), "approved"), "apply": (("approved",), "applied")}


#: Which of the four values an issue's status may take; any may follow any.
ISSUE_STATUS = ("open", "acknowledged", "resolved", "ignored")


def _proposals(df: DataFrame, kind: str, corrected, confidence: float) -> DataFrame:
    out = df.select("dataset", "column_name", F.lit(kind).alias("correction_type"), F.col("value").alias("original"), corrected.alias("corrected"), F.lit(confidence).alias("confidence"))
    return out.filter("corrected is not null")


def propose_currency(values: DataFrame, synonyms: dict[str, str] = rules.CURRENCY_SYNONYMS) -> DataFrame:
    """values: dataset, column_name, value (bad currency codes)."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return _proposals(values, "normalize_currency", table[text.normalised(F.col("value"))], 0.9)


def propose_dates(values: DataFrame) -> DataFrame:
    return _proposals(values, "normalize_date", text.iso_date(F.col("value")), 0.7)


def propose_trim(values: DataFrame) -> DataFrame:
    t = text.trimmed(F.col("value"))
    return _proposals(values, "trim_whitespace", F.when(t != F.col("value"), t), 0.95)


def propose_duplicate_removal(issues: DataFrame) -> DataFrame:
    some = issues.filter("issue_type = 'duplicate'")
    return some.select("dataset", "column_name", F.lit("remove_duplicate").alias("correction_type"), F.lit(None).cast("string").alias("original"), F.lit(None).cast("string").alias("corrected"), F.lit(0.7).alias("confidence"))


def apply_verdicts(proposals: DataFrame, verdicts: DataFrame, default: float = 0.8) -> DataFrame:
    """Outside corrections by (dataset, column_name, original) go before the heuristics; UNKNOWN and null ones count as none."""
    good = verdicts.filter("corrected is not null and upper(corrected) <> 'UNKNOWN'").withColumn("confidence", F.coalesce("confidence", F.lit(default)))
    rest = proposals.join(good.select("dataset", "column_name", "original"), ["dataset", "column_name", "original"], "left_anti")
    return good.select(*proposals.columns).unionByName(rest)


def list_corrections(corrections: DataFrame, dataset: str | None = None, status: str | None = None) -> DataFrame:
    for col, want in (("dataset", dataset), ("status", status)):
        corrections = corrections if want is None else corrections.filter(F.col(col) == want)
    return corrections.orderBy(F.desc("confidence"), "dataset", "column_name", "original")


def link_corrections(corrections: DataFrame, issues: DataFrame) -> DataFrame:
    """Each correction with its issue: same table, column (null meets null) and the issue type that its own type mends."""
    kind = F.create_map(*[F.lit(x) for kv in rules.ISSUE_OF_CORRECTION.items() for x in kv])
    c = corrections.withColumn("mends", F.coalesce(kind[F.col("correction_type")], F.col("correction_type")))
    i = issues.select(F.col("dataset").alias("_d"), F.col("column_name").alias("_c"), F.col("issue_type").alias("_t"), "severity")
    return c.join(i, (F.col("dataset") == F.col("_d")) & F.col("column_name").eqNullSafe(F.col("_c")) & (F.col("mends") == F.col("_t")), "left").drop("_d", "_c", "_t")


def review_state(items: DataFrame, events: DataFrame, key: str, transitions=TRANSITIONS) -> DataFrame:
    """key, status: legal events folded in order of seq, starting from pending. An illegal event changes nothing.

    events: key, action, seq. A key has a handful of review events, so they are folded as one sorted array.
    """
    log = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("log"))

    def step(state, e):
        return reduce(lambda out, t: F.when((e["action"] == t[0]) & state.isin(*t[1][0]), F.lit(t[1][1])).otherwise(out), transitions.items(), state)

    folded = F.aggregate(F.coalesce("log", F.array().cast("array<struct<seq:bigint,action:string>>")), F.lit("pending"), step)
    return items.select(key).distinct().join(log.select(key, F.transform("log", lambda e: F.struct(e["seq"].cast("bigint").alias("seq"), e["action"].alias("action"))).alias("log")), key, "left").select(key, folded.alias("status"))


def issue_status(issues: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """issues with status: the last valid change of each (keys, status, seq), open where there is none. Values that no issue can have change nothing."""
    # the last change to each status first: a maximum of numbers is hashed, one of structs would be sorted
    latest = changes.filter(F.col("status").isin(*ISSUE_STATUS)).groupBy(*keys, "status").agg(F.max("seq").alias("seq"))
    last = latest.groupBy(*keys).agg(F.max_by("status", F.struct("seq", "status")).alias("status"))
    same = [issues[k].eqNullSafe(last[k]) for k in keys]
    return issues.drop("status").join(last, reduce(lambda a, b: a & b, same), "left").select(*[issues[c] for c in issues.columns if c != "status"], F.coalesce(last["status"], F.lit("open")).alias("status"))


def apply_all(tables: dict[str, DataFrame], approved: DataFrame, at_once: int = 4, deadline: float | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(corrected cells by table, a run per table): each table's corrections in a run of its own; one that fails or takes too long leaves the others as they are. tables: cells by name."""
    from ..sources import runs

    work = lambda name, cells: lambda: apply_corrections(cells, approved.filter(F.col("dataset") == name))[0]
    return runs.run_all(approved.sparkSession, {n: work(n, c) for n, c in tables.items()}, at_once, deadline)


def apply_corrections(cells: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with corrected values, corrections with their affected row counts).

    Currency codes come out in upper case; a cell that a date correction touched also has its date in date_value. A value matches a correction by its trimmed lower-case form. Where several match one cell, the last by (confidence, original)
    wins; every one that matches is counted.
    """
    fix = approved.filter("corrected is not null").withColumn("norm", text.normalised(F.col("original")))
    w = Window.partitionBy("dataset", "column_name", "norm").orderBy("confidence", F.desc("original"))
    kind = F.col("correction_type") if "correction_type" in fix.columns else F.lit(None).cast("string")
    fix = fix.withColumn("_kind", kind).withColumn("corrected", F.when(F.col("_kind") == "normalize_currency", F.upper("corrected")).otherwise(F.col("corrected")))
    last = fix.withColumn("_at", F.row_number().over(w)).groupBy("dataset", "column_name", "norm").agg(F.max_by("corrected", "_at").alias("new"), F.max_by("_kind", "_at").alias("_kind"))
    keyed = cells.withColumn("norm", text.normalised(F.col("value")))
    out = keyed.join(last, ["dataset", "column_name", "norm"], "left").withColumn("was", F.col("value")).withColumn("value", F.coalesce("new", "value"))
    out = out.withColumn("date_value", F.when(F.col("_kind") == "normalize_date", F.try_to_date("value"))).drop("norm", "new", "_kind")
    hits = keyed.groupBy("dataset", "column_name", "norm").agg(F.count("*").alias("affected_rows"))
    return out, fix.join(hits, ["dataset", "column_name", "norm"], "left").drop("norm", "_kind").fillna({"affected_rows": 0})


def corrected_table(df: DataFrame, dataset: str, approved: DataFrame) -> DataFrame:
    """A whole table with its corrections, all other columns as they are. Only columns that have a correction are joined; their values keep text type.

    A value matches by its trimmed lower-case form, as in apply_corrections, and so does what wins where several match.
    """
    fixed = [r.column_name for r in approved.filter((F.col("dataset") == dataset) & F.col("corrected").isNotNull()).select("column_name").distinct().collect()]  # names of columns
    out = df
    for c in (c for c in df.columns if c in fixed):
        fix = approved.filter((F.col("dataset") == dataset) & (F.col("column_name") == c) & F.col("corrected").isNotNull())
        code = F.when(F.col("correction_type") == "normalize_currency", F.upper("corrected")).otherwise(F.col("corrected"))
        w = Window.partitionBy("_norm").orderBy(F.desc("confidence"), "original")
        best = fix.select(text.normalised(F.col("original")).alias("_norm"), code.alias("_new"), "confidence", "original").withColumn("_at", F.row_number().over(w)).filter("_at = 1").select("_norm", "_new")
        own = out.withColumn("_norm", text.normalised(F.col(f"`{c}`").cast("string")))
        out = own.join(best, "_norm", "left").withColumn(c, F.coalesce("_new", F.col(f"`{c}`").cast("string"))).select(*df.columns)
    return out
