"""Connected components by alternating large-star and small-star rounds.

Each round is two groupings of the edges with map-side minima, and the number of rounds grows with the logarithm
of the longest chain. Edges are rewritten so that every node points at the least node it knows of, so a star of any
size stays as many rows as it has leaves. Hubs are safe: groupings carry minima, never lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import materialise

MOST_ROUNDS = 64


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v). Each node's neighbours above it (large) or at and below it (small) move to its least one."""
    around = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:
        around = around.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of one ordered type. Gives (node, root), root the least node of its component, one row a node.

    Nulls and loops are passed over, repeated edges count once; no edges give no rows.
    """
    now = materialise(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        now = materialise(_star(_star(now, small=False), small=True), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
