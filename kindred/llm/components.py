"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated), written to the shared folder, and a join back to it, in
which Spark can split the edges of a star's centre: no component meets in one task. Stars of a few
rounds need a few steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: each node links its larger neighbours to its least one; small: each
    node links its smaller neighbours and itself to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        least = materialize(least, "least")
        out = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` has columns a and b."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    while True:
        step = materialize(_star(_star(pairs, True), False), "edges")
        state = tuple(step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(pairs)
        pairs = step
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
