"""Entity resolution: normalise, match, connect, name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..sources import scratch
from ..sources import tables as S
from . import vectors


def entity_rows(values: DataFrame, columns: DataFrame) -> DataFrame:
    """Values of embeddable columns with their role."""
    return values.join(columns.filter(F.col("role").isin(*rules.EMBEDDABLE_ROLES)).select("dataset", "column_name", "role"), ["dataset", "column_name"])


def normalised_groups(entities: DataFrame) -> DataFrame:
    """role, norm, representative (the smallest raw value), n: equal values are one before anything is compared."""
    return entities.withColumn("norm", text.normalised(F.col("value"))).groupBy("role", "norm").agg(F.min("value").alias("representative"), F.sum("n").alias("n"))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node) from undirected edges a, b. Nodes without an edge are their own.

    Every round passes the smallest label on along the edges and then lets every node take the label of its label, so the
    number of rounds grows with the logarithm of the longest path. Rounds are kept in the shared folder; nothing but
    the number of changes reaches the driver.
    """
    both = scratch.stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("node", "other"), "edges")
    label = scratch.stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", F.least("component", "c").alias("m"), F.col("component").alias("was"))
        jump = label.select(F.col("node").alias("m"), F.col("component").alias("mm"))
        new = scratch.stored(step.join(jump, "m", "left").select("node", F.least("m", "mm").alias("component"), "was"), "labels")
        moved = new.filter("component <> was").isEmpty()
        label = new.select("node", "component")
        if moved:
            break
    if nodes is None:
        return label
    return nodes.select(F.col(nodes.columns[0]).alias("node")).join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def canonical_names(members: DataFrame) -> DataFrame:
    """component, canonical_name: the most frequent raw value; ties go to the smaller one. members: component, value, n."""
    counted = members.groupBy("component", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("component").orderBy(F.desc("n"), "value")
    return counted.withColumn("_at", F.row_number().over(w)).filter("_at = 1").select("component", F.col("value").alias("canonical_name"))


def cluster_confidence(members: DataFrame, values: DataFrame) -> DataFrame:
    """component, size, confidence: 1 - the largest distance between two members. members: node, component; values: node, v.

    Chains may hold members further apart than the threshold, so all pairs count; bounds from three members decide most of them (vectors.widest).
    """
    wide = vectors.widest(members.join(values, "node").select("component", F.col("node").alias("id"), "v"), "component")
    return wide.select("component", "size", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("far"))).alias("confidence"))


def aliases(entities: DataFrame, members: DataFrame) -> DataFrame:
    """dataset, column_name, value, component: one alias per raw value. members: role, norm, component."""
    return entities.withColumn("norm", text.normalised(F.col("value"))).join(members, ["role", "norm"]).select("dataset", "column_name", "value", "role", "component")


def dataset_nodes(datasets: DataFrame, embedded: DataFrame) -> DataFrame:
    return datasets.join(embedded.select("dataset").distinct(), "dataset", "left_semi")


def vector_source_stats(attached: DataFrame) -> DataFrame:
    """Share of values whose vector is a hash or unknown, and the warning that goes with it."""
    weak = F.coalesce("embedding_source", F.lit("unknown")).isin("hash", "unknown")
    out = attached.agg(F.count("*").alias("total"), F.count_if(weak).alias("weak"))
    share = F.when(F.col("total") > 0, F.col("weak") / F.col("total")).otherwise(0.0)
    return out.withColumn("weak_share", share).withColumn("warning", F.when(F.col("weak") == F.col("total"), "all vectors are hashes").when(F.col("weak") > 0, "some vectors are hashes"))


def embed_entities(existing: DataFrame | None, values: DataFrame, given: DataFrame | None = None, dim: int = 1536) -> DataFrame:
    """dataset, column_name, value, vector, embedding_source: a vector for every value, over those there were.

    values: dataset, column_name, value. A value that stands in several columns is embedded once. given: value, vector.
    """
    made = vectors.attach_vectors(values.select("value").distinct(), given, "value", dim=dim)
    fresh = values.select("dataset", "column_name", "value").distinct().join(made, "value").select("dataset", "column_name", "value", "vector", "embedding_source")
    return fresh if existing is None else S.upsert(existing, fresh, ["dataset", "column_name", "value"])
