"""Isolated runs, the run log, and tables that are replaced as a whole."""

import threading
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trustloom.operators import corrections as K
from trustloom.operators import graph as G
from trustloom.operators import model as A
from trustloom.operators import quality as Q
from trustloom.sources import runs, versions
from trustloom.sources import tables as S


def test_a_run_that_fails_or_hangs_ends_alone(spark):
    @F.udf("long")
    def slow(x):
        time.sleep(120)
        return x

    works = {"good": lambda: spark.range(7), "bad": lambda: spark.range(3).select("no_such_column"), "breaks": lambda: spark.range(1).select(F.raise_error(F.lit("broken cell")).alias("x")), "hangs": lambda: spark.range(1).select(slow("id").alias("x"))}
    began = time.time()
    done, log = runs.run_all(spark, works, deadline=15)
    assert time.time() - began < 100
    got = {r.name: r for r in log.collect()}
    assert {n: r.status for n, r in got.items()} == {"good": "ok", "bad": "failed", "breaks": "failed", "hangs": "cancelled"}
    assert got["good"].row_count == 7 and got["good"].error is None and done.keys() == {"good"} and done["good"].count() == 7
    assert "no_such_column" in got["bad"].error and got["hangs"].error == "after 15 s" and all(r.ended >= r.began for r in got.values())


def test_runs_are_side_by_side(spark):
    meet = threading.Barrier(3, timeout=60)

    def work():
        meet.wait()
        return spark.range(1)

    assert {r.status for r in runs.run_all(spark, {n: work for n in "abc"}, at_once=3)[1].collect()} == {"ok"}


def test_run_log(spark):
    rows = [("a", 1, "start", None), ("a", 2, "finish", "ok"), ("a", 3, "finish", "failed"), ("a", 4, "start", None), ("a", 5, "note", None), ("a", 6, "start", None), ("b", 1, "finish", "ok"), ("b", 2, "start", None), ("b", 4, "finish", "ok")]
    events = spark.createDataFrame(rows, "run string, seq int, kind string, said string").withColumn("at", F.timestamp_seconds("seq"))
    got = runs.intervals(events, ["run"], "at", ["seq"], F.col("kind") == "start", F.col("kind") == "finish", F.col("said")).orderBy("run", "run_no").collect()
    assert [(r.run, r.run_no, r.status, r.seconds, r.finish_count, r.finished is None) for r in got] == [("a", 1, "failed", 2.0, 2, False), ("a", 2, "abandoned", None, 0, True), ("a", 3, "running", None, 0, True), ("b", 1, "ok", 2.0, 1, False)]
    assert runs.intervals(events.limit(0), ["run"], "at", ["seq"], F.col("kind") == "start", F.col("kind") == "finish", F.col("said")).count() == 0


def test_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    base = str(tmp_path / "graph")
    assert versions.versions(spark, base) == [] and versions.manifest(spark, base) is None
    with pytest.raises(FileNotFoundError):
        versions.read_tables(spark, base)
    assert versions.replace_tables({"nodes": spark.range(3), "edges": spark.range(2)}, base) == 1
    assert versions.replace_tables({"nodes": spark.range(5), "edges": spark.range(4)}, base, expected=1) == 2
    broken = spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(PySparkException):
        versions.replace_tables({"nodes": spark.range(9), "edges": broken}, base)
    now = versions.read_tables(spark, base)
    assert (now["nodes"].count(), now["edges"].count(), versions.versions(spark, base)) == (5, 4, [1, 2])
    with pytest.raises(versions.Conflict):
        versions.replace_tables({"nodes": spark.range(1)}, base, expected=1)
    (tmp_path / "graph" / "_versions" / f"{3:020d}.json").write_text('{"tables": ')  # a writer that died
    assert versions.read_tables(spark, base)["nodes"].count() == 5
    assert versions.replace_tables({"nodes": spark.range(6), "edges": spark.range(1)}, base) == 4
    assert versions.read_tables(spark, base, 1)["nodes"].count() == 3
    assert versions.forget(spark, base, keep=1) == 3 and versions.versions(spark, base) == [4]
    assert versions.read_tables(spark, base)["nodes"].count() == 6


def test_writers_at_once_commit_one_version_each(spark, tmp_path):
    base, got = str(tmp_path / "t"), []
    threads = [threading.Thread(target=lambda i=i: got.append(versions.replace_tables({"t": spark.range(i + 1)}, base))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == versions.versions(spark, base) == [1, 2, 3, 4]


def test_upsert_takes_the_same_row_of_a_repeated_key(spark):
    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", None)], "k int, v string, n int")
    for df in (new, new.orderBy(F.desc("v"))):
        assert sorted(map(tuple, S.upsert(old, df, ["k"]).collect())) == [(1, "c", 1), (2, "d", None)]


def test_seeds_walk_side_by_side(spark):
    edges = spark.createDataFrame([("d1", "g1", "has"), ("g1", "v1", "has"), ("v1", "v2", "co_occurs_with"), ("d2", "d1", "fk"), ("v2", "g3", "has")], "from_id string, to_id string, edge_type string")
    nodes = spark.createDataFrame([("d1", "cost_table", "dataset"), ("d2", "gl_table", "dataset"), ("d3", "other", "dataset")], "id string, name string, entity_type string")
    seeds = G.domain_seeds(nodes, "Finance Domain")
    around, between = G.neighbourhood(edges, seeds)
    assert sorted(map(tuple, around.collect())) == [("d1", "d1", 0), ("d1", "d2", 1), ("d1", "g1", 1), ("d1", "v1", 2), ("d2", "d1", 1), ("d2", "d2", 0), ("d2", "g1", 2)]
    assert {(r.from_id, r.to_id) for r in between.collect()} == {("d1", "g1"), ("g1", "v1"), ("d2", "d1")}
    assert G.neighbourhood(edges, seeds.limit(0))[1].count() == 0


def test_collapsed_groups_keep_shared_children(spark):
    edges = spark.createDataFrame([("g1", "a", "contains_reference"), ("g1", "b", "contains_reference"), ("g2", "b", "contains_reference"), ("a", "b", "co_occurs_with"), ("gone", "a", "contains_reference")], "from_id string, to_id string, edge_type string")
    nodes = spark.createDataFrame([("g1",), ("g2",), ("a",), ("b",)], "id string")
    shut = nodes.filter("id = 'g1'")
    plain, shared = G.collapsed(nodes, edges, shut), G.collapsed(nodes, edges, shut, exclusive=True)
    assert {r.id for r in plain[0].collect()} == {"g1", "g2"} and plain[1].count() == 0
    assert {r.id for r in shared[0].collect()} == {"g1", "g2", "b"} and {(r.from_id, r.to_id) for r in shared[1].collect()} == {("g1", "b"), ("g2", "b")}


def test_issue_states_and_report(spark):
    issues = spark.createDataFrame([("t", None, "duplicate", "error", 3), ("t", "c", "invalid_date", "warning", 1)], "dataset string, column_name string, issue_type string, severity string, affected_rows long")
    changes = spark.createDataFrame([("t", None, "duplicate", "resolved", 1), ("t", None, "duplicate", "ignored", 2), ("t", None, "duplicate", "nonsense", 3)], "dataset string, column_name string, issue_type string, status string, seq int")
    stated = K.issue_status(issues, changes, ["dataset", "column_name", "issue_type"])
    assert {r.issue_type: r.status for r in stated.collect()} == {"duplicate": "ignored", "invalid_date": "open"}
    scores = spark.createDataFrame([(f"t{i}", 0.5 + i / 100, ["mend it"]) for i in range(30)], "dataset string, overall double, recommendations array<string>")
    fixes = spark.createDataFrame([("t", "c", "normalize_date", str(i), "x", 0.7, "pending" if i else "applied", i) for i in range(25)], "dataset string, column_name string, correction_type string, original string, corrected string, confidence double, status string, seq int")
    got = Q.report_board(stated.withColumn("seq", F.col("affected_rows")), scores, fixes).collect()
    summary = {r.detail: r.value for r in got if r.section == "summary"}
    assert summary == {"issues": 2, "critical": 1, "open": 1, "pending": 24, "scored": 30, "mean": 0.645}
    assert [r.dataset for r in got if r.section == "worst"] == [f"t{i}" for i in range(10)]
    assert [r.detail.split("/")[2] for r in sorted((r for r in got if r.section == "corrections"), key=lambda r: r.place)] == [str(i) for i in range(24, 4, -1)]


def test_quality_report_is_whole(spark):
    issues = spark.createDataFrame([("t", None, "duplicate", "error", 3, "ignored"), ("t", "c", "invalid_date", "warning", 1, "open")], "dataset string, column_name string, issue_type string, severity string, affected_rows long, status string")
    scores = spark.createDataFrame([(f"t{i}", 0.5 + i / 100) for i in range(30)], "dataset string, overall double")
    schemas = spark.createDataFrame([("ERP", "date", 0.5), ("ERP", "vendor", 1.0)], "source_type string, role string, frequency double")
    fixes = spark.createDataFrame([("t", "c", "normalize_date", str(i), "x", 0.7, "pending" if i else "applied", i) for i in range(25)], "dataset string, column_name string, correction_type string, original string, corrected string, confidence double, status string, seq int")
    got = {(r.metric, r.key): r.n for r in Q.quality_report(issues, scores, fixes, schemas).collect()}
    assert {k: n for (m, k), n in got.items() if m == "total"} == {"schemas": 2, "issues": 2, "critical": 1, "open": 1, "corrections": 25, "pending": 24, "scored": 30}
    assert got["issue_status", "ignored"] == got["issue_status", "open"] == 1 and got["correction", "applied"] == 1 and got["below_0.7", "all"] == 20
    assert {k for m, k in got if m == "attention"} == {f"t{i}" for i in range(20)}  # all of them, not ten
    assert got["schema", "ERP/date"] == 0.5 and got["issue", "t/duplicate/error/ignored"] == 3
    assert {k for m, k in got if m == "latest_correction"} == {f"t/c/normalize_date/{i}/x" for i in range(5, 25)}


def test_quality_report_counts_duplicate_removals(spark, tmp_path):
    """A repeated row of line items is a correction that the report counts and lists."""
    from trustloom.plans import catalogue

    sf = "/root/testdata/sf0.001"
    for t in ("customer", "part", "orders"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.union(lines.limit(1)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.metric, r.key): r.n for r in catalogue.QUERIES["quality_report"](spark, str(tmp_path)).collect()}
    assert got["latest_correction", "shipments/remove_duplicate"] == 0.7
    assert got["total", "corrections"] == got["correction", "pending"] == 1 + catalogue.QUERIES["report_board"](spark, str(tmp_path)).filter("detail = 'pending'").first().value


def test_spikes_and_new_services(spark):
    rows = [("a", f"2024-{m:02d}-15", 10.0 + m % 2) for m in range(1, 7)] + [("a", "2024-07-01", 99.0), ("a", "2025-03-01", 50.0), ("b", "2025-03-02", 5.0), ("b", None, 1.0)]
    facts = spark.createDataFrame(rows, "service string, day string, cost double").withColumn("day", F.to_date("day"))
    got = {(r.service, r.month_no): r for r in A.cost_spikes(facts, ["service"], "day", "cost").collect()}
    july, march = got["a", 2024 * 12 + 6], got["a", 2025 * 12 + 2]
    assert july.is_spike and july.known == 6 and july.gap == 0
    assert not march.is_spike and march.known == 0 and march.gap == 7
    assert {r.service: (r.is_new, r.months_seen, r.early_cost) for r in A.new_services(facts, "service", "day", "cost").collect()} == {"a": (False, 8, 32.0), "b": (True, 1, 5.0)}
