"""Density clusters over a graph of near neighbours, and assignment of new vectors to centroids.

Defined cases: a node with at least least - 1 neighbours is a core; clusters are components of cores; a border
node joins its smallest core neighbour's cluster; all others have no cluster. Edges count once in either direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import vectors as V
from siftspark.operators.components import components


def density_clusters(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """node, cluster (smallest core of it, or null) for nodes (node) and edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least - 1).select(F.col("a").alias("node"))
    inner = both.join(core.select(F.col("node").alias("a")), "a", "left_semi").join(core.select(F.col("node").alias("b")), "b", "left_semi")
    roots = core.join(components(inner), "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))
    border = both.join(core.select(F.col("node").alias("a")), "a", "left_anti").join(roots.select(F.col("node").alias("b"), "cluster"), "b")
    border = border.groupBy("a").agg(F.min_by("cluster", "b").alias("cluster")).select(F.col("a").alias("node"), "cluster")
    return nodes.select("node").distinct().join(roots.unionByName(border), "node", "left")


def centroids(members: DataFrame) -> DataFrame:
    """cluster, centroid, size of rows (cluster, embedding)."""
    flat = members.where("cluster is not null").select("cluster", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    mean = flat.groupBy("cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    out = mean.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"), F.max("n").alias("size"))
    return out.select("cluster", F.expr("transform(v, p -> p.x)").alias("centroid"), "size")


def assigned(new: DataFrame, centers: DataFrame, least: float) -> DataFrame:
    """id, cluster of rows (id, embedding): the nearest centroid by cosine, null below `least`; centroids are few."""
    rows = new.select("id", "embedding").join(F.broadcast(centers.select("cluster", "centroid")), how="cross")
    near = rows.groupBy("id").agg(F.max(F.struct(V.cosine(F.col("embedding"), F.col("centroid")).alias("c"), "cluster")).alias("m"))
    return near.select("id", F.when(F.col("m.c") >= least, F.col("m.cluster")).alias("cluster"))
