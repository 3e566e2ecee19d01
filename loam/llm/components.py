"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.storage import Scratch


def _star(scratch: Scratch, edges: DataFrame, large: bool, name: str) -> DataFrame:
    """Link neighbours of each node to the smallest of them; kept as the table ``name``.

    Large: all larger neighbours, over edges in both directions.  Small: the
    node itself and its smaller neighbours.  The minimum is pre-aggregated, written,
    and then joined, so a hub's neighbours are split over tasks and never gathered.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
    least = scratch.keep(least, f"least-{name}")
    if large:
        moved = edges.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    out = scratch.keep(moved.where("u <> v").distinct(), name)
    scratch.drop(f"least-{name}")
    return out


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of a proper edge; the component is its
    smallest node.  Self loops, repeated edges and nulls are left out."""
    scratch = Scratch(edges.sparkSession, "components")
    proper = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current, mark = scratch.keep(proper, "edges-0"), None
    for k in range(max_rounds):
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = now
        large = _star(scratch, current, True, f"large-{k}")
        scratch.drop(f"edges-{k}")
        current = _star(scratch, large, False, f"edges-{k + 1}")
        scratch.drop(f"large-{k}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
