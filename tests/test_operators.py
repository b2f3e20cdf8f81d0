"""Small literal cases for the operators; the queries have their SQL twins (test_queries.py)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trustloom.functions import text
from trustloom.operators import columns as C
from trustloom.operators import corrections as K
from trustloom.operators import graph as G
from trustloom.operators import model as A
from trustloom.operators import profile as P
from trustloom.operators import quality as Q
from trustloom.operators import resolve as R
from trustloom.operators import taxonomy as M
from trustloom.operators import vectors as V
from trustloom.sources import tables as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_name_similarity(spark):
    sim = lambda a, b: one(spark, text.name_similarity(F.lit(a), F.lit(b)))
    assert (sim("Vendor Name", "vendor_name"), sim("vendor", "vendor_id"), sim("vendor", "date"), sim("", "a")) == (1.0, 0.65, 0.0, 0.0)


def test_overrides(spark):
    rows = [("Vendor Name",), ("vendor_id",), ("Cost Center + Name",), ("Journal ID",), ("Vendor Contact Email",), ("Owner",)]
    df = spark.createDataFrame(rows, "column_name string").withColumns({"role": F.lit("other"), "role_confidence": F.lit(0.3), "is_technical": F.lit(False)})
    got = {r.column_name: (r.role, r.is_technical) for r in C.override_roles(df).collect()}
    assert got == {"Vendor Name": ("vendor", False), "vendor_id": ("vendor", False), "Cost Center + Name": ("description", False), "Journal ID": ("identifier", True), "Vendor Contact Email": ("other", False), "Owner": ("person", False)}


@pytest.mark.parametrize(
    ("cols", "kept"),
    [
        ([("Vendor Name", "vendor", ["x"]), ("Vendor ID", "vendor", ["1"])], {"Vendor Name"}),
        ([("Vendor ID", "vendor", ["1"])], {"Vendor ID"}),
        ([("Vendor Name", "vendor", ["x"]), ("Legacy Vendor Name", "vendor", ["y"]), ("Vendor ID", "vendor", ["1"])], {"Vendor Name", "Legacy Vendor Name", "Vendor ID"}),
        ([("Vendor Name", "vendor", ["x"]), ("Rapid", "vendor", ["y"])], {"Vendor Name", "Rapid"}),
        ([("Vendor", "vendor", ["x"]), ("VendorID", "vendor", ["y"])], {"Vendor"}),
        ([("Cost Center", "cost_center", ["CC-200", "CC-210"]), ("Cost Center Name", "cost_center", ["Apps - Back Office", "Apps"])], {"Cost Center Name"}),
        ([("Storage Device ID", "infrastructure_asset", ["1"])], {"Storage Device ID"}),
    ],
)
def test_pairing(spark, cols, kept):
    df = spark.createDataFrame([("d", *c) for c in cols], "dataset string, column_name string, role string, samples array<string>")
    rest, pairs = C.pair_id_columns(df)
    assert {r.column_name for r in rest.collect()} == kept
    assert pairs.count() == len(cols) - len(kept)


@pytest.mark.parametrize(("args", "want"), [((1, 23 / 52838, 1, 1, 1), (True, False, 0.98)), ((0.9, 0.1, 0.99, 0, 1), (False,)), ((0.4, 0.1, 0.99, 1, 1), (False,)), ((0.8, 0.5, 0.6, 1, 1), (False,))])
def test_key_decision(spark, args, want):
    got = spark.range(1).select(*G.key_decision(*[F.lit(float(a)) for a in args])).first()
    assert tuple(got)[: len(want)] == want


def test_lexical_and_rules(spark):
    assert one(spark, text.lexical_score(F.lit("cloud compute hosting"), F.lit("Compute"), F.lit("cloud hosting compute"))) == 1.0
    assert one(spark, text.lexical_score(F.lit("payroll management"), F.lit("Network > LAN"), F.lit("LAN"))) == 0.0
    label = lambda p: one(spark, text.rule_label(F.lit("AWS EC2 instance"), F.lit(p), F.lit("resource_tower")))
    assert label("Compute > Servers") == "compute technology"
    assert label("Network > LAN") is None


def test_edge_labels(spark):
    label = lambda c, r: one(spark, text.edge_label(F.lit(c), F.lit(r)))
    assert (label("Manufacturer", "vendor"), label("Vendor Name", "vendor"), label("Cost Center Name", "cost_center")) == ("HAS_MANUFACTURER", "HAS_VENDOR", "HAS_COST_CENTER")


def test_iso_dates(spark):
    got = [one(spark, text.iso_date(F.lit(v))) for v in ("3/7/2024", "07-03-2024", "7.3.2024", "2024/3/7", " 2024-03-07 ", "soon")]
    assert got == ["2024-03-07"] * 5 + [None]


def test_profile_of_nulls_and_blanks(spark):
    df = spark.createDataFrame([(1, None, "2024-01-01"), (2, "", "2024-01-02"), (3, "x", None)], "id int, a string, d string")
    got = {r.column_name: r for r in P.profile_columns(S.cells(df, "t")).collect()}
    assert (got["id"].is_key, got["id"].inferred_type) == (True, "number")
    assert (got["a"].nulls, got["a"].distinct_count, got["a"].samples, got["a"].inferred_type) == (2, 3, ["x"], "string")
    assert (got["d"].inferred_type, got["d"].distinct_count) == ("date", 3)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id int, a string")
    assert P.profile_columns(S.cells(df, "t")).count() == 0
    assert Q.duplicates(df, "t", ["id"]).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_components(spark, pairs):
    nodes = sorted({x for p in pairs for x in p} | {99})
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a int, b int")
    got = R.connected_components(edges, spark.createDataFrame([(n,) for n in nodes], "n int"))
    assert {r.node: r.component for r in got.collect()} == root


def test_cosine(spark):
    d = lambda a, b: one(spark, V.cosine_distance(F.lit(a), F.lit(b)))
    assert (round(d([1.0, 0.0], [0.0, 2.0]), 9), round(d([1.0, 1.0], [2.0, 2.0]), 9), d([0.0, 0.0], [1.0, 1.0])) == (1.0, 0.0, 1.0)


def test_lsh_finds_near_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, 0, x.tolist()) for i, x in enumerate(base)] + [(100 + i, 1, (x + 0.05 * rng.standard_normal(16)).tolist()) for i, x in enumerate(base)]
    df = spark.createDataFrame(rows, "id int, grp int, v array<double>")
    exact = {(r.a, r.b) for r in V.similar_pairs(df, 0.1, None).collect()}
    found = {(r.a, r.b) for r in V.similar_pairs(df, 0.1, None, "lsh", dim=16).collect()}
    assert found <= exact
    assert len(found) >= 0.9 * len(exact) > 30
    assert V.lsh_recall(0.01, 8, 12) > 0.9


def test_review(spark):
    events = spark.createDataFrame([("a", "apply", 1), ("a", "approve", 2), ("a", "apply", 3), ("b", "reject", 1), ("b", "approve", 2)], "item string, action string, seq long")
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    assert {r.item: r.status for r in K.review_state(items, events, "item").collect()} == {"a": "applied", "b": "rejected", "c": "pending"}


def test_corrections_apply_once(spark):
    cells = S.cells(spark.createDataFrame([(" usd",), ("euro",), ("EUR",)], "currency string"), "t")
    fix = K.propose_currency(cells.select("dataset", "column_name", "value")).union(spark.createDataFrame([("t", "currency", "normalize_currency", "usd", "USD", 0.9)], "a string, b string, c string, d string, e string, f double"))
    out, hits = K.apply_corrections(cells, fix)
    again, _ = K.apply_corrections(out.drop("was"), fix)
    assert sorted(r.value for r in out.collect()) == sorted(r.value for r in again.collect()) == ["EUR", "EUR", "USD"]
    assert {r.original: r.affected_rows for r in hits.collect()} == {"euro": 1, "usd": 1}


def test_merge_edges_in_any_grouping(spark):
    e = lambda *rows: spark.createDataFrame(rows, "from_id int, to_id int, edge_type string, weight long, confidence double, label string, seq long")
    got = S.merge_edges(e((1, 2, "t", 1, 0.5, "a", 1)), e((1, 2, "t", 2, 0.9, "b", 2))).first()
    assert (got.weight, got.confidence, got.label) == (3, 0.9, "b")


def test_mapping_decision(spark):
    ranked = spark.createDataFrame([("a", "x", "p > x", 0.1, 0.9, 1.0, "r", 0.9, 1), ("a", "y", "p > y", 0.2, 0.8, 0.0, None, 0.5, 2), ("b", "x", "p > x", 0.9, 0.1, 0.0, None, 0.1, 1)], "id string, category string, path string, distance double, similarity double, lexical double, rule string, score double, rank int")
    got = {r.id: r for r in M.decide_mapping(ranked).collect()}
    assert (got["a"].status, got["a"].category, len(got["a"].alternatives)) == ("approved", "x", 1)
    assert (got["b"].status, got["b"].category, got["b"].method) == ("unresolved", None, "unresolved")
    verdict = spark.createDataFrame([("a", 2, None)], "id string, choice int, confidence double")
    got = {r.id: r for r in M.decide_mapping(M.apply_mapping_verdicts(ranked, verdict)).collect()}
    assert (got["a"].category, got["a"].confidence, got["a"].method) == ("y", 0.5, "hybrid_llm")


def test_model(spark):
    nodes = spark.createDataFrame([("v", "Acme", "vendor", 2), ("g", "grp", "attribute_group", 0), ("d", "t.csv", "dataset", 0)], "id string, name string, entity_type string, alias_count long")
    edges = spark.createDataFrame([("d", "g", "contains_reference", None, 0.9, "t"), ("d", "v", "co_occurs_with", "USES_VENDOR", 0.8, "t"), ("v", "d", "maps_to_category", None, 0.8, "t")], "from_id string, to_id string, edge_type string, label string, confidence double, dataset string")
    classes = spark.createDataFrame([("v", "resource_tower", "IT", "Storage", "IT > Storage", 0.9), ("v", "cost_pool", "Outside Services", None, "Outside Services", 0.7), ("v", "resource_tower", "IT", "Compute", "IT > Compute", 0.5)], "id string, layer string, level_1 string, level_2 string, path string, confidence double")
    datasets = spark.createDataFrame([("t", "t.csv", 3)], "dataset string, file_name string, row_count long")
    objs = A.objects(nodes, classes, A.entity_sources(edges, datasets))
    o = objs.first()
    assert (objs.count(), o.resource_tower, o.cost_pool, o.solution, o.mapping_confidence, o.sources) == (1, "Storage", "Outside Services", None, 0.8, ["t.csv"])
    rels = A.relationships(edges, nodes, datasets)
    assert [(r.relationship, r.evidence) for r in rels.collect()] == [("USES_VENDOR", "t.csv")]
    score = spark.createDataFrame([("t", 0.6, 1, 0)], "dataset string, overall double, issue_count int, critical_issue_count int")
    src = A.source_datasets(datasets, score)
    assert src.first().is_ready is False
    assert A.model_warnings(objs.withColumn("mapping_confidence", F.lit(None).cast("double")), rels, src).count() == 2


def test_ingest_goes_on_after_a_failure(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x , y\n1,\n2,b\n")
    done, log = S.ingest_batch(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none.csv")], lambda p, df: df)
    assert done[str(tmp_path / "a.csv")].columns == ["x", "y"]
    assert sorted(r.status for r in log.collect()) == ["failed", "ok"]


def test_written_versions(spark, tmp_path):
    df = spark.range(3)
    assert spark.read.parquet(S.write_corrected_copy(df, str(tmp_path / "c"), "s1")).count() == 3
