"""Graphs as edge tables: (src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.sources.tables import checkpointed

#: Edges of a task of a traversal.
EDGES_A_TASK = 250_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: the smallest node of each connected component.

    Large and small stars in turn: each links a node's neighbours to the smallest of
    them.  Minima are pre-aggregated and joined, never gathered per node.
    """
    now = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _dealt(edges: DataFrame) -> DataFrame:
    """Distinct edges, dealt by ``src`` into as many tasks as there are edges for: a fixed
    number of tasks, or tasks joined by their compressed bytes, grow with the table."""
    edges = checkpointed(edges.select("src", "dst"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES_A_TASK))
    return edges.repartition(parts, "src").distinct()


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int, directed: bool = True) -> DataFrame:
    """``(seed, node, depth)``: nodes within ``max_depth`` edges of each seed, with the
    least depth.  Each round joins the newly reached nodes only."""
    if not directed:
        edges = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = _dealt(edges)
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("depth"))
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        reached = reached.unionByName(frontier)
    return reached


def shortest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 4) -> DataFrame:
    """``(seed, node, depth, path)``: a shortest directed path; of equals the first by
    its nodes.  A node keeps one path, so paths don't multiply."""
    edges = _dealt(edges)
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("depth"), F.array("node").alias("path"))
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = checkpointed(best.join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")).select("seed", "node", "depth", "path"))
        reached = reached.unionByName(frontier)
    return reached


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours in and out, self loops left out, nodes without edges kept."""
    e = edges.where("src <> dst")
    out = e.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    found = nodes.select("node").join(into, "node", "left").join(out, "node", "left")
    return found.select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def dbscan(pairs: DataFrame, nodes: DataFrame, min_points: int = 3) -> DataFrame:
    """``(node, role, cluster)`` from the pairs within reach: cores have at least
    ``min_points`` neighbours, clusters are components of cores named by their
    smallest, a border node joins the smallest cluster it touches.  The pairs are made once
    and written: they are read many times."""
    pairs = checkpointed(pairs.select("src", "dst"))
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    cores = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= min_points).select(F.col("src").alias("node"))
    inner = pairs.join(cores.withColumnRenamed("node", "src"), "src", "left_semi").join(cores.withColumnRenamed("node", "dst"), "dst", "left_semi")
    joined = cores.join(components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    touched = both.join(joined, both["dst"] == joined["node"]).groupBy("src").agg(F.min("cluster").alias("cluster")).withColumnRenamed("src", "node")
    border = touched.join(cores, "node", "left_anti")
    found = joined.select("node", F.lit("core").alias("role"), "cluster").unionByName(border.select("node", F.lit("border").alias("role"), "cluster"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("role", F.lit("noise")).alias("role"), "cluster")
