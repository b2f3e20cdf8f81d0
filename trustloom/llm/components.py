"""Connected components by repeated contraction, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node that has a link; root is one node of its component.

    Each round points every node at its least neighbour (in an order given by a hash, so that chains are cut at many
    places at once), and replaces the links' ends by what they point at. Nothing but the number of links left reaches
    the driver. Self links and nulls don't count.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = scratch.stored(one.union(one.select("v", "u")).distinct(), "links")
    found: DataFrame | None = None
    while not edges.isEmpty():
        least = edges.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        points = scratch.stored(least.select("u", F.least("m", own)["v"].alias("p")), "points")
        at_u = edges.join(points, "u").select(F.col("p").alias("pu"), "v")
        moved = at_u.join(points.select(F.col("u").alias("v"), "p"), "v").filter("pu <> p")
        edges = scratch.stored(moved.select(F.col("pu").alias("u"), F.col("p").alias("v")).distinct(), "links")
        if found is None:
            found = points.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = found.join(points, found.root == points.u, "left")
            found = scratch.stored(step.select("node", F.coalesce("p", "root").alias("root")), "roots")
    return found if found is not None else one.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
