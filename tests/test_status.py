"""States of issues are folded from many changes."""

from trustloom.operators import corrections as K


def test_last_status(spark):
    issues = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    changes = spark.createDataFrame([("a", "open", 1), ("a", "resolved", 3), ("a", "open", 2), ("b", "ignored", 5), ("b", "open", 5), ("c", "done", 9), (None, "ignored", 1)], "k string, status string, seq long")
    assert {r.k: r.status for r in K.issue_status(issues, changes, ["k"]).collect()} == {"a": "resolved", "b": "open", "c": "open", None: "ignored"}
