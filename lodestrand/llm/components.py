"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side, so a hub's edges are reduced before the shuffle), written as a table
of one row a node, and an equi-join with it. As both sides of the join are plain scans, adaptive execution can split the
partition of a hub. Edges never reach the driver; only their count and checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v): large links larger neighbours to the least one, small links the smaller ones and u."""
    if large:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return linked.where("u > v").distinct()


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """edges (a, b: of one type that can be compared) -> (node, component): the least node that each node reaches.

    Self-loops, repeated and null edges are ignored; a node without an edge to another node isn't listed.
    """
    kept = edges.where("a is not null and b is not null and a != b")
    now = materialize(kept.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_steps):
        now = materialize(_star(materialize(_star(now, True), "edges"), False), "edges")
        sums = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
