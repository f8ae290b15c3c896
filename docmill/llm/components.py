"""Connected components by distributed union-find: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """For each u its least neighbour, or itself; sums up in each task first, so hot nodes are cheap."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one node at most, and on none if others hang on it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    each = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.sum("holds").alias("holds"))
    return each.where("hangs > 1 OR hangs > 0 AND holds > 0").isEmpty()


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node, component (the least node reached) of the nodes of ``edges`` (u, v; bigint).

    Nulls and loops are left out, repeated edges count once; nodes without edges have no row. Each
    round hangs all larger neighbours of a node on its least one, then all smaller ones, and is
    written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, name)
    for _ in range(rounds):
        if _are_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        before, edges = edges, materialize(small.distinct(), name)
        discard(before)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)
