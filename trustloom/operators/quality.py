"""Canonical schemas, quality issues and readiness.

Issues have one shape: dataset, column_name, issue_type, severity, affected_rows, samples (at most five, in order of value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import scratch
from ..sources import tables as S
from . import profile as profiles

ISSUE = ("dataset", "column_name", "issue_type", "severity", "affected_rows", "samples")


def canonical_schemas(columns: DataFrame, required: float = 0.8) -> DataFrame:
    """Per source type and role: share of its tables that have the role, and name and type of the first. columns: source_type, dataset, column_name, ordinal, role, inferred_type, is_technical."""
    totals = columns.groupBy("source_type").agg(F.count_distinct("dataset").alias("total"))
    roles = columns.filter(~F.col("is_technical") & F.col("role").isNotNull()).groupBy("source_type", "role").agg(F.count_distinct("dataset").alias("n"), F.min(F.struct("dataset", "ordinal", "column_name", "inferred_type")).alias("first"))
    out = roles.join(totals, "source_type").withColumn("frequency", F.col("n") / F.col("total"))
    return out.select("source_type", "role", F.col("first.column_name").alias("column_name"), F.col("first.inferred_type").alias("inferred_type"), "frequency", (F.col("frequency") >= required).alias("is_required"))


def list_schemas(schemas: DataFrame, source_type: str | None = None) -> DataFrame:
    some = schemas if source_type is None else schemas.filter(F.col("source_type") == source_type)
    return some.orderBy("source_type", F.desc("is_required"), F.desc("frequency"), "role")


def _issue(df: DataFrame, kind: str, severity: Column, affected: Column, samples: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return df.select("dataset", "column_name", F.lit(kind).alias("issue_type"), severity.alias("severity"), affected.cast("long").alias("affected_rows"), (none if samples is None else samples).alias("samples"))


def missing_values(profile: DataFrame) -> DataFrame:
    some = profile.filter("null_share > 0.5")
    return _issue(some, "missing_value", F.when(F.col("null_share") > 0.8, "error").otherwise("warning"), F.col("nulls"))


def schema_mismatches(columns: DataFrame, schemas: DataFrame) -> DataFrame:
    want = schemas.select("source_type", "role", F.col("inferred_type").alias("want"))
    some = columns.join(want, ["source_type", "role"]).filter("inferred_type <> want")
    return _issue(some, "schema_mismatch", F.lit("warning"), F.lit(None))


def counted(cells: DataFrame) -> DataFrame:
    """dataset, column_name, value, n: each different value with its rows; a table that has n is one already (profile.value_counts)."""
    if "n" in cells.columns:
        return cells.select("dataset", "column_name", "value", "n")
    return cells.groupBy("dataset", "column_name", "value").agg(F.count("*").alias("n"))


def _bad_values(cells: DataFrame, value: Column, bad: Column, keep: int | None = None) -> DataFrame:
    """Different bad values of each column (the first `keep` by value), with the rows that hold them. A value is tested once, however many rows hold it."""
    found = counted(cells).select("dataset", "column_name", value.alias("value"), bad.alias("bad"), "n").filter("bad").groupBy("dataset", "column_name", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("dataset", "column_name").orderBy("value")
    ranked = found.withColumn("_at", F.row_number().over(w))
    first = ranked.filter(F.col("_at") <= (5 if keep is None else min(5, keep))).groupBy("dataset", "column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    total = found.groupBy("dataset", "column_name").agg(F.sum("n").alias("n"), F.count("*").alias("different"))
    return total.join(first, ["dataset", "column_name"])


def invalid_currencies(cells: DataFrame, codes=rules.CURRENCIES) -> DataFrame:
    some = cells.filter(F.lower("column_name").contains("currency"))
    code = F.upper(text.trimmed(F.col("value")))
    return _issue(_bad_values(some, code, (code != "") & ~code.isin(*codes)), "invalid_currency", F.lit("error"), F.col("n"), F.col("samples"))


def dated(profile: DataFrame) -> DataFrame:
    """dataset, column_name: the columns whose values should be dates."""
    return profile.filter((F.col("inferred_type") == "date") | F.lower("column_name").contains("date")).select("dataset", "column_name")


def invalid_dates(cells: DataFrame, profile: DataFrame) -> DataFrame:
    some = cells.join(F.broadcast(dated(profile)), ["dataset", "column_name"]).filter("value <> ''")
    return _issue(_bad_values(some, F.col("value"), text.parsed_date(F.col("value")).isNull()), "invalid_date", F.lit("warning"), F.col("n"), F.col("samples"))


def outliers(cells: DataFrame, profile: DataFrame, sigmas: float = 3, least: int = 10) -> DataFrame:
    """Numeric columns with values more than `sigmas` deviations from their mean: two aggregates over the different values."""
    numeric = profile.filter("inferred_type = 'number'").select("dataset", "column_name")
    v = counted(cells.join(F.broadcast(numeric), ["dataset", "column_name"])).withColumn("x", F.col("value").try_cast("double")).filter("x is not null")
    v = v.groupBy("dataset", "column_name", "x").agg(F.sum("n").alias("n"), F.min("value").alias("value"))
    total = F.sum("n")
    stats = v.groupBy("dataset", "column_name").agg(total.alias("rows"), (F.sum(F.col("x") * F.col("n")) / total).alias("mean"))
    spread = v.join(F.broadcast(stats), ["dataset", "column_name"]).groupBy("dataset", "column_name", "rows", "mean").agg(F.sqrt(F.sum(F.col("n") * (F.col("x") - F.col("mean")) ** 2) / F.first("rows")).alias("std"))
    far = v.join(F.broadcast(spread.filter((F.col("rows") > least) & (F.col("std") > 0))), ["dataset", "column_name"]).filter(F.abs(F.col("x") - F.col("mean")) > sigmas * F.col("std"))
    return _far_values(far)


def column_outliers(tables: dict[str, DataFrame], profile: DataFrame, sigmas: float = 3, least: int = 10, rename=S.strip_prefix) -> DataFrame:
    """The same from whole tables: two passes over the numeric columns. The first returns a count, a mean and a deviation per column, the second keeps the values beyond; no other value is exchanged or made a text."""
    numeric = {(r.dataset, r.column_name) for r in profile.filter("inferred_type = 'number'").select("dataset", "column_name").collect()}
    cols = {d: [f for f in df.schema.fields if (d, rename(f.name)) in numeric] for d, df in tables.items()}
    x = lambda f: profiles.number_of(F.col(f"`{f.name}`"), f.dataType)
    stats = [tables[d].agg(F.array(*[F.struct(F.lit(i).alias("i"), F.count(x(f)).alias("rows"), F.avg(x(f)).alias("mean"), F.stddev_pop(x(f)).alias("std")) for i, f in enumerate(fs)]).alias("a")).select(F.lit(d).alias("dataset"), F.inline("a")) for d, fs in cols.items() if fs]
    found = {(r.dataset, r.i): r for r in (reduce(DataFrame.unionByName, stats).collect() if stats else [])}
    frames = []
    for d, fs in cols.items():
        entries = []
        for i, f in enumerate(fs):
            r = found[d, i]
            if r.rows > least and r.std > 0:
                cell = F.struct(F.lit(rename(f.name)).alias("column_name"), x(f).alias("x"), S.as_text(F.col(f"`{f.name}`"), f.dataType).alias("value"))
                entries.append(F.when(F.abs(x(f) - F.lit(r.mean)) > sigmas * r.std, cell))
        if entries:
            frames.append(tables[d].select(F.lit(d).alias("dataset"), F.inline(F.array_compact(F.array(*entries)))))
    spark = profile.sparkSession
    cells = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "dataset string, column_name string, x double, value string")
    return _far_values(scratch.stored(cells.groupBy("dataset", "column_name", "x").agg(F.count("*").alias("n"), F.min("value").alias("value")), "far"))


def _far_values(far: DataFrame) -> DataFrame:
    w = Window.partitionBy("dataset", "column_name").orderBy("value")
    first = far.withColumn("_at", F.row_number().over(w)).filter("_at <= 5").groupBy("dataset", "column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    out = far.groupBy("dataset", "column_name").agg(F.sum("n").alias("n")).join(first, ["dataset", "column_name"])
    return _issue(out, "outlier", F.lit("info"), F.col("n"), F.col("samples"))


def invalid_references(cells: DataFrame, columns: DataFrame, names: DataFrame) -> DataFrame:
    """Values of embeddable columns that aren't canonical names of their type, where the type has any. names: role, canonical_name."""
    some = columns.filter(F.col("role").isin(*rules.EMBEDDABLE_ROLES)).join(names.select("role").distinct(), "role", "left_semi").select("dataset", "column_name", "role")
    values = counted(cells.join(F.broadcast(some), ["dataset", "column_name"], "left_semi")).join(F.broadcast(some), ["dataset", "column_name"]).filter("value <> ''")
    known = names.select("role", F.lower("canonical_name").alias("norm")).distinct()
    bad = values.withColumn("norm", text.normalised(F.col("value"))).join(known, ["role", "norm"], "left_anti")
    w = Window.partitionBy("dataset", "column_name").orderBy("value")
    first = bad.withColumn("_at", F.row_number().over(w)).filter("_at <= 5").groupBy("dataset", "column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    total = bad.groupBy("dataset", "column_name").agg(F.sum("n").alias("n"))
    return _issue(total.join(first, ["dataset", "column_name"]), "invalid_reference", F.lit("warning"), F.col("n"), F.col("samples"))


def duplicates(df: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    """Rows that repeat the key columns, beyond the first of each; an error above a tenth of all rows."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    stats = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("extra"))
    first = groups.filter("n > 1").orderBy(*keys).limit(5).agg(F.array_sort(F.collect_list(name)).alias("samples"))
    out = stats.filter("extra > 0").join(first, F.lit(True)).withColumn("dataset", F.lit(dataset)).withColumn("column_name", F.lit(None).cast("string"))
    return _issue(out, "duplicate", F.when(F.col("extra") > 0.1 * F.col("rows"), "error").otherwise("warning"), F.col("extra"), F.col("samples"))


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in rules.SEVERITY_PENALTY]), c), F.lit(9))


def list_issues(issues: DataFrame, dataset: str | None = None, severity: str | None = None) -> DataFrame:
    for col, want in (("dataset", dataset), ("severity", severity)):
        issues = issues if want is None else issues.filter(F.col(col) == want)
    return issues.orderBy(severity_rank(F.col("severity")), "dataset", "issue_type", "column_name")


def readiness(catalogue: DataFrame, columns: DataFrame, schemas: DataFrame, issues: DataFrame, weights: dict[str, float] = rules.READINESS_WEIGHTS) -> DataFrame:
    """Four scores and their weighted sum per table. catalogue: dataset, source_type, row_count."""
    need = catalogue.select("dataset", "source_type").join(schemas.filter("is_required").select("source_type", "role"), "source_type")
    have = columns.filter("not is_technical").select("dataset", "role", F.lit(1).alias("present")).distinct()
    complete = need.join(have, ["dataset", "role"], "left").groupBy("dataset").agg((F.count("present") / F.count("*")).alias("completeness"))
    penalty = reduce(lambda out, kv: F.when(F.col("severity") == kv[0], kv[1]).otherwise(out), rules.SEVERITY_PENALTY.items(), F.lit(0.05))
    validity = F.col("issue_type").isin("invalid_date", "invalid_currency", "invalid_reference", "missing_value")
    by = issues.groupBy("dataset").agg(
        F.count("*").alias("issue_count"),
        F.count_if(F.col("severity").isin("critical", "error")).alias("critical_issue_count"),
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(F.when(validity, penalty)), F.lit(0.0))).alias("validity"),
        (1 - F.least(0.1 * F.count_if(F.col("issue_type") == "invalid_reference"), F.lit(0.5))).cast("double").alias("consistency"),
        F.max(F.when(F.col("issue_type") == "duplicate", F.col("affected_rows"))).alias("repeated"),
        *[F.count_if(F.col("issue_type") == k).alias(k) for k in ("invalid_date", "invalid_currency", "missing_value", "invalid_reference", "outlier", "schema_mismatch")],
    )
    out = catalogue.join(complete, "dataset", "left").join(by, "dataset", "left").fillna({"completeness": 1.0, "validity": 1.0, "consistency": 1.0, "issue_count": 0, "critical_issue_count": 0})
    out = out.withColumn("uniqueness", F.when((F.col("repeated") > 0) & (F.col("row_count") > 0), 1 - F.col("repeated") / F.col("row_count")).otherwise(1.0))
    score = reduce(lambda s, kv: s + F.col(kv[0]) * kv[1], weights.items(), F.lit(0.0))
    return out.withColumn("overall", F.round(score, 3)).withColumn("recommendations", recommendations())


def recommendations() -> Column:
    """Advice in a fixed order, by the scores and the kinds of issues."""
    c, some = F.col, lambda k: F.coalesce(F.col(k), F.lit(0)) > 0
    # fixed values: the texts
    advice = (
        (c("completeness") < 0.8, "Add missing required columns based on the canonical schema for this source type"),
        ((c("validity") < 0.8) & some("invalid_date"), "Normalize date formats to ISO 8601 (YYYY-MM-DD)"),
        ((c("validity") < 0.8) & some("invalid_currency"), "Standardize currency codes to ISO 4217"),
        ((c("validity") < 0.8) & some("missing_value"), "Review and fill missing required values"),
        ((c("consistency") < 0.9) & some("invalid_reference"), "Resolve entity reference mismatches by adding missing entities to the knowledge graph or correcting values"),
        (c("uniqueness") < 0.95, "Review and remove duplicate rows to ensure data integrity"),
        (some("outlier"), "Investigate outlier values to determine if they are data entry errors"),
        (some("schema_mismatch"), "Align column data types with canonical schema expectations"),
    )
    found = F.filter(F.array(*[F.when(when, F.lit(t)) for when, t in advice]), lambda x: x.isNotNull())
    high = reduce(lambda a, k: a & (c(k) >= 0.95), rules.READINESS_WEIGHTS, F.lit(True))
    default = F.when(high, "Dataset is ready, with high quality scores").otherwise("Continue monitoring data quality metrics")
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def list_readiness(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("overall"), "dataset")


def quality_report(issues: DataFrame, scores: DataFrame, corrections: DataFrame, schemas: DataFrame, latest: int = 20, below: float = 0.7) -> DataFrame:
    """metric, key, n: the whole report in one shape. issues and corrections: with status; corrections also with seq.

    total: schemas, issues, critical and open ones, corrections, pending ones, tables scored. Counts of issues by type, severity and status, and of
    corrections by state. The mean score, how many tables score below `below`, and each of these with its score (attention). Every canonical schema
    with its frequency, every issue with its affected rows, and the latest corrections with their confidence.
    """
    row = lambda df, metric, key, n: df.select(F.lit(metric).alias("metric"), key.alias("key"), n.cast("double").alias("n"))
    by = lambda df, metric, col: row(df.groupBy(col).agg(F.count("*").alias("_n")), metric, F.col(col), F.col("_n"))
    one = lambda df, metric, key, n: row(df.agg(n.alias("_n")), metric, F.lit(key), F.col("_n"))
    low, every = F.col("overall") < below, F.count("*")
    totals = [
        (schemas, "schemas", every), (issues, "issues", every), (issues, "critical", F.count_if(F.col("severity").isin("critical", "error"))), (issues, "open", F.count_if(F.col("status") == "open")),
        (corrections, "corrections", every), (corrections, "pending", F.count_if(F.col("status") == "pending")), (scores, "scored", every),
    ]
    last = corrections.orderBy(F.desc("seq")).limit(latest)  # a top-k report
    parts = [
        *[one(df, "total", key, n) for df, key, n in totals], *[by(issues, k, c) for k, c in (("issue_type", "issue_type"), ("severity", "severity"), ("issue_status", "status"))], by(corrections, "correction", "status"),
        one(scores, "mean_score", "all", F.avg("overall")), one(scores, f"below_{below:g}", "all", F.count_if(low)), row(scores.filter(low), "attention", F.col("dataset"), F.col("overall")),
        row(schemas, "schema", F.concat_ws("/", "source_type", "role"), F.col("frequency")), row(issues, "issue", F.concat_ws("/", "dataset", "column_name", "issue_type", "severity", "status"), F.col("affected_rows")),
        row(last, "latest_correction", F.concat_ws("/", "dataset", "column_name", "correction_type", "original", "corrected"), F.col("confidence")),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_board(issues: DataFrame, scores: DataFrame, corrections: DataFrame, worst: int = 10, latest: int = 20, below: float = 0.7) -> DataFrame:
    """section, place, dataset, detail, value: the parts of a report that are lists, and the counts above them.

    summary: issues, critical ones, open ones, pending corrections, tables scored, mean score. worst: the tables that score below `below`, lowest first, with their advice.
    issues, corrections: the latest ones, the last in their own order first. issues: with status and seq; corrections: with status and seq.
    """
    def ranked(df, section, order, n, detail, value):
        top = df.orderBy(*order).limit(n)  # a top-k report
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(section).alias("section"), "place", "dataset", detail.alias("detail"), value.cast("double").alias("value"))

    counts = [
        (issues, "issues", F.count("*")), (issues, "critical", F.count_if(F.col("severity").isin("critical", "error"))), (issues, "open", F.count_if(F.col("status") == "open")),
        (corrections, "pending", F.count_if(F.col("status") == "pending")), (scores, "scored", F.count("*")), (scores, "mean", F.round(F.coalesce(F.avg("overall"), F.lit(0.0)), 3)),
    ]
    summary = [df.agg(n.cast("double").alias("value")).select(F.lit("summary").alias("section"), F.lit(i + 1).alias("place"), F.lit(None).cast("string").alias("dataset"), F.lit(name).alias("detail"), "value") for i, (df, name, n) in enumerate(counts)]
    parts = [
        *summary, ranked(scores.filter(F.col("overall") < below), "worst", ["overall", "dataset"], worst, F.array_join("recommendations", "; "), F.col("overall")),
        ranked(issues, "issues", [F.desc("seq")], latest, F.concat_ws("/", "column_name", "issue_type", "severity", "status"), F.col("affected_rows")),
        ranked(corrections, "corrections", [F.desc("seq")], latest, F.concat_ws("/", "column_name", "correction_type", "original", "corrected"), F.col("confidence")),
    ]
    return reduce(DataFrame.unionByName, parts)
