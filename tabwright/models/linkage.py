"""Single linkage: the edges of an exact minimum spanning tree, by searches of growing radius.

Every tree edge no longer than a radius joins two components of the points within it, and is the shortest between them.
So the radius starts near the distance of nearest neighbours, where the edges in reach are few, and grows fourfold: from then
on only grid cells that hold different components are compared, and a block tells the shortest edge of each pair of
components, never its pairs. The edges in reach go through Borůvka rounds: each component takes its shortest edge (ties
by the edge's points), components are joined, and edges inside a component fall away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.components import FEW_EDGES, connected_components, small_components
from tabwright.functions.quantiles import quantile_dict
from tabwright.operators.grid import Grid, _dealt_groups
from tabwright.operators.knn import knn_join
from tabwright.session import cut_lineage

PAIRS = 1 << 20  # pairs compared at once, about


def _kruskal(spark, edges):
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    taken = []
    for e in sorted(edges, key=lambda r: (r["dist"], r["u"], r["v"])):
        a, b = top(e["a"]), top(e["b"])
        if a != b:
            up[max(a, b)] = min(a, b)
            taken.append((e["u"], e["v"], e["dist"]))
    if not taken:
        return None, None
    return (spark.createDataFrame(taken, "u string, v string, dist double"),
            spark.createDataFrame([(x, top(x)) for x in list(up)], "node string, component string"))


def boruvka(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of edges (a, b, dist, u, v) between components: the edges chosen (u, v, dist) and
    (node, component) of all nodes that have an edge. Edges are ordered by (dist, u, v), u < v."""
    edges = cut_lineage(edges)
    few = edges.limit(FEW_EDGES + 1).collect()
    if len(few) <= FEW_EDGES:  # a fixed bound: the same forest in memory, edge by edge
        return _kruskal(edges.sparkSession, few)
    chosen, named = None, None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist", "u", "v"))
        best = cut_lineage(both.groupBy("a").agg(F.min(F.struct("dist", "u", "v", "b")).alias("e"))
                           .select("a", "e.*"))
        take = best.select("u", "v", "dist").distinct()
        chosen = take if chosen is None else chosen.unionByName(take)
        found = cut_lineage(connected_components(best.select("a", "b")))
        if named is None:
            named = found
        else:
            step = found.select(F.col("node").alias("component"), F.col("component").alias("now"))
            named = cut_lineage(named.join(step, "component", "left")
                                .select("node", F.coalesce("now", "component").alias("component")))
        to = {x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_now")) for x in "ab"}
        edges = cut_lineage(
            edges.join(to["a"], "a", "left").join(to["b"], "b", "left")
            .select(F.coalesce("a_now", "a").alias("a"), F.coalesce("b_now", "b").alias("b"), "dist", "u", "v")
            .where("a <> b")
            .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .agg(F.min(F.struct("dist", "u", "v")).alias("e")).select("a", "b", "e.*"))
    return chosen, named


def _foreign_edges(grid: Grid, points: DataFrame) -> DataFrame:
    """Shortest edge (a, b, dist, u, v) in the radius per pair of components and block, of points (id, vec, cell, box,
    component)."""
    import numpy as np
    import pandas as pd
    cells = cut_lineage(points.groupBy("cell").agg(F.first("box").alias("box"), F.min("component").alias("lo"),
                                                   F.max("component").alias("hi")))
    other = cells.select(F.col("cell").alias("other"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    pairs = cut_lineage(grid.pairs(cells, cells).where("cell <= other").select("cell", "other")
                        .join(cells.select("cell", "lo", "hi"), "cell").join(other, "other")
                        .where("lo < hi or olo < ohi or lo <> olo").select("cell", "other"))
    radius, n = grid.radius, 1024
    parts = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(n)).cast("int").alias("n"))
    blocks = (pairs.join(parts, "cell").join(parts.select(F.col("cell").alias("other"), F.col("n").alias("on")), "other")
              .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("on") - 1))).select("cell", "other", "p", "q"))
    blocks = cut_lineage(blocks)
    dealt = points.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("part"),
                                              "id", "vec", "component")
    sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    rows = blocks.join(sizes, "cell").join(sizes.select(F.col("cell").alias("other"), F.col("n").alias("on")), "other")
    most = F.least("n", F.lit(n)) + F.least("on", F.lit(n))
    keys = ["cell", "other", "p", "q"]
    blocks = blocks.withColumn("g", F.pmod(F.xxhash64(*keys), F.lit(_dealt_groups(rows, most))))
    left = blocks.join(dealt.withColumnRenamed("part", "p"), ["cell", "p"])
    right = blocks.join(dealt.withColumnsRenamed({"cell": "other", "part": "q"}), ["other", "q"])

    def shortest(ai, bi, dist, c, order):
        """Of edges between rows ai and bi the shortest per pair of components ``c``; ties by the rows' ``order``."""
        flip = order[ai] > order[bi]
        u, v = np.where(flip, bi, ai), np.where(flip, ai, bi)
        lo, hi = np.minimum(c[ai], c[bi]), np.maximum(c[ai], c[bi])
        at = np.lexsort((order[v], order[u], dist, hi, lo))
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(lo[at]) != 0) | (np.diff(hi[at]) != 0)
        at = at[first]
        return u[at], v[at], dist[at]

    def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        cols = ["a", "b", "dist", "u", "v"]
        if not (len(x) and len(y)):
            return pd.DataFrame({c: pd.Series([], dtype=float if c == "dist" else object) for c in cols})
        both = pd.concat([x, y], ignore_index=True)
        vecs = np.stack(both["vec"].to_numpy()).astype(float)
        ids, order = np.unique(both["id"].to_numpy(object).astype(str), return_inverse=True)
        names, c = np.unique(both["component"].to_numpy(object).astype(str), return_inverse=True)
        near = {k: v + len(x) for k, v in y.groupby(keys, sort=False).indices.items()}
        blocks = [(i, near[k]) for k, i in x.groupby(keys, sort=False).indices.items() if k in near]
        kept: list = []

        def compare(some):
            """All pairs of the rows of ``some`` blocks at once."""
            nl, nr = np.array([len(i) for i, _ in some]), np.array([len(j) for _, j in some])
            li, ri = np.concatenate([i for i, _ in some]), np.concatenate([j for _, j in some])
            lo, ro = np.cumsum(nl) - nl, np.cumsum(nr) - nr
            pairs = nl * nr
            k = np.repeat(np.arange(len(some)), pairs)
            at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            ai, bi = li[lo[k] + at // nr[k]], ri[ro[k] + at % nr[k]]
            other = c[ai] != c[bi]
            ai, bi = ai[other], bi[other]
            sq = np.zeros(len(ai))
            for j in range(vecs.shape[1]):
                sq += (vecs[ai, j] - vecs[bi, j]) ** 2
            dist = np.sqrt(sq)
            ok = dist <= radius
            kept.append(shortest(ai[ok], bi[ok], dist[ok], c, order))
        some, held = [], 0
        for i, j in blocks:
            for s in range(0, len(i), 256):
                some.append((i[s:s + 256], j))
                held += len(some[-1][0]) * len(j)
                if held > PAIRS:
                    compare(some)
                    some, held = [], 0
        if some:
            compare(some)
        u, v, dist = (np.concatenate([e[t] for e in kept]) if kept else np.zeros(0, int) for t in range(3))
        u, v, dist = shortest(u.astype(int), v.astype(int), dist, c, order)
        lo, hi = np.minimum(c[u], c[v]), np.maximum(c[u], c[v])
        return pd.DataFrame({"a": names[lo].astype(object), "b": names[hi].astype(object), "dist": dist.astype(float),
                             "u": ids[order[u]].astype(object), "v": ids[order[v]].astype(object)})[cols]
    right = right.select(F.col("g").alias("rg"), *[F.col(k).alias(k) for k in [*keys, "id", "vec", "component"]])
    found = (left.groupBy("g").cogroup(right.groupBy("rg"))
             .applyInPandas(block, "a string, b string, dist double, u string, v string"))
    return found.groupBy("a", "b").agg(F.min(F.struct("dist", "u", "v")).alias("e")).select("a", "b", "e.*")


def single_linkage(points: DataFrame, d: int, k: int) -> DataFrame:
    """(id, component) of single linkage over distinct points (id string, vec): at most ``k`` components, those left
    when the ``k - 1`` longest edges of the minimum spanning tree are cut (ties: the later by (u, v))."""
    points = cut_lineage(points.select("id", "vec"))
    n = points.count()
    labels = points.select("id", F.col("id").alias("component"))
    if n <= k:
        return labels
    near = knn_join(points, None, 3, "id", "vec", dedupe=False)
    radius = quantile_dict(near.where("rank = 3 or dist > 0"), ["dist"], [0.5]).get(("dist", 0.5)) or 1.0
    tree, left = None, n
    while left > k:
        grid = Grid(points.join(labels, "id"), d, radius)
        edges = _foreign_edges(grid, grid.points)
        chosen, named = boruvka(edges)
        if chosen is not None:
            step = named.select(F.col("node").alias("component"), F.col("component").alias("now"))
            labels = cut_lineage(labels.join(step, "component", "left")
                                 .select("id", F.coalesce("now", "component").alias("component")))
            chosen = cut_lineage(chosen)
            tree = chosen if tree is None else tree.unionByName(chosen)
            left = n - tree.count()
        radius *= 4.0
    # every edge beyond the last radius is longer than those found, so the longest of these make up the rest of the cut
    if left == k:
        return labels
    longest = tree.orderBy(F.desc("dist"), F.desc("u"), F.desc("v")).limit(k - left)
    kept = tree.join(longest, ["u", "v"], "left_anti")
    found = small_components(kept.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return (points.select("id").join(found.withColumnRenamed("node", "id"), "id", "left")
            .select("id", F.coalesce("component", "id").alias("component")))
