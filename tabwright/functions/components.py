"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of each component: edges (a, b) of orderable non-null ids -> (node, component).

    Alternates large-star and small-star (each one aggregation by node), which contracts a component in a
    logarithmic number of rounds, until the edge set stops changing. Every node of an edge is returned, nodes
    without an edge are not. A star is two columns, so a hot centre is met only by map-side combined minima
    and by joins whose large side Spark may split. Each round is checkpointed in the shared folder.
    """
    e = (edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    e = cut_lineage(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    stamp = None
    while True:
        # large-star: every neighbour above a node is linked with the node's smallest neighbour (or itself)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small-star: a node links its smaller neighbours and itself with the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == stamp:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        stamp = tuple(now)


FEW_EDGES = 100_000  # at most so many are joined up in memory


def roots(edges) -> dict:
    """Smallest node of each node's component, of (a, b) pairs in memory."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def small_components(edges: DataFrame) -> DataFrame:
    """As ``connected_components``; at most ``FEW_EDGES`` edges (a fixed bound) are joined up on the driver, which saves
    the rounds. Nodes are strings."""
    edges = cut_lineage(edges.where("a <> b").distinct())
    few = edges.limit(FEW_EDGES + 1).collect()
    if len(few) > FEW_EDGES:
        return connected_components(edges)
    return edges.sparkSession.createDataFrame(list(roots((r["a"], r["b"]) for r in few).items()),
                                              "node string, component string")
