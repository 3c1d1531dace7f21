"""Clustering models returning ``(id, cluster)``.

- kmeans: Spark ML KMeans. hclust: single linkage from an exact minimum
  spanning tree (``models.linkage``).
- sc: PowerIterationClustering on the kNN graph (Gaussian weights).
- dbscan: grid cells whose points are all within eps, counted by totals;
  components over cells; only thin and border cells compare points.
- meanshift: binned seeds, flat-kernel mean shift over grid cell totals (points
  are compared in cut cells only; seeds of a tile walk many rounds in a task
  where tiles are small), modes merged on a half-bandwidth grid, rows
  labelled by nearest mode.
- ap: affinity propagation over all pairs (``models.affinity``). With
  ``n_neighbors`` restricted to the kNN graph, which is approximate:
  responsibilities and availabilities as windows over rows and over candidate
  exemplars, damped rounds.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, PowerIterationClustering
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.components import small_components
from tabwright.functions.quantiles import quantile_dict
from tabwright.functions.ranks import numbered
from tabwright.operators.anomaly import incomplete
from tabwright.operators.grid import Grid
from tabwright.operators.knn import knn_join
from tabwright.session import cut_lineage


def _vec(df, features, id_col):
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("vec"))


def kmeans(df: DataFrame, features: list[str], id_col: str, k: int = 4, seed: int = 42):
    x = VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="skip").transform(df.select(id_col, *features))
    m = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="cluster").fit(x)
    rest = incomplete(df, features).select(F.col(id_col), F.lit(None).cast("int").alias("cluster"))
    return m.transform(x).select(F.col(id_col), F.col("cluster").cast("int")).unionByName(rest)


def spectral(df: DataFrame, features: list[str], id_col: str, k: int = 4, n_neighbors: int = 10, seed: int = 42):
    rest = incomplete(df, features).select(F.col(id_col), F.lit(None).cast("int").alias("cluster"))
    v = _vec(df, features, id_col).where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    v = v.withColumn("nid_long", F.xxhash64("id"))
    nb = knn_join(v, None, n_neighbors, "id", "vec")
    sigma = quantile_dict(nb, ["dist"], [0.5]).get(("dist", 0.5)) or 1.0
    ids = v.select(F.col("id").alias("qid"), F.col("nid_long").alias("src"))
    idn = v.select(F.col("id").alias("nid"), F.col("nid_long").alias("dst"))
    edges = (nb.join(ids, "qid").join(idn, "nid")
             .select("src", "dst", F.exp(-(F.col("dist") ** 2) / F.lit(2 * sigma * sigma)).alias("weight")))
    pic = PowerIterationClustering(k=k, maxIter=20, weightCol="weight")
    a = pic.assignClusters(edges)
    found = v.join(a, v["nid_long"] == a["id"]).select(v["id"].alias(id_col), F.col("cluster").cast("int"))
    return found.unionByName(rest)


def _distinct_points(df: DataFrame, features: list[str], id_col: str):
    """(complete rows with their vector key, distinct vectors with multiplicity and smallest id, rows with nulls)."""
    from functools import reduce
    vec = F.array(*[F.col(c).cast("double") for c in features])
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features])
    rows = (df.where(full).select(F.col(id_col).alias("id"), vec.alias("vec"))
            .withColumn("vk", F.md5(F.to_json("vec"))))
    # -0.0 and 0.0 are one place
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    pts = rows.groupBy("vk").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least"))
    rest = df.where(~F.coalesce(full, F.lit(False))).select(F.col(id_col))
    return rows.select("id", "vk"), cut_lineage(pts), rest


def _grid(pts: DataFrame, features: list[str], eps: float) -> Grid:
    return Grid(pts.withColumnRenamed("vk", "id"), len(features), eps)


def core_flags(df: DataFrame, features: list[str], id_col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``(id, neighbours, is_core)``: rows within ``eps`` (self and identical copies included); null in both for rows
    with a null or NaN feature."""
    rows, pts, rest = _distinct_points(df, features, id_col)
    grid = _grid(pts, features, eps)
    cnt = grid.count(grid.points.select("id", "vec"), "m").withColumnRenamed("id", "vk")
    out = rows.join(cnt, "vk").select(F.col("id").alias(id_col), "neighbours",
                                      (F.col("neighbours") >= min_samples).alias("is_core"))
    return out.unionByName(rest.select(F.col(id_col), F.lit(None).cast("long").alias("neighbours"),
                                       F.lit(None).cast("boolean").alias("is_core")))


REPS = 32  # points of a cell tried first when two cells are to be joined


def _linked_cells(grid: Grid, core: DataFrame) -> DataFrame:
    """(cell, component) of the cells with core points (id, vec, cell, box): components of core points within the radius.

    A cell's own points are within the radius of each other. Of neighbouring cells a few points are compared first;
    what these leave in different components is compared whole.
    """
    import numpy as np
    cells = cut_lineage(core.groupBy("cell").agg(F.first("box").alias("box")))
    pairs = cut_lineage(grid.pairs(cells, cells).where("cell < other").select("cell", "other"))
    w = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
    reps = (core.withColumn("r", F.row_number().over(w)).where(F.col("r") <= REPS)
            .groupBy("cell").agg(F.flatten(F.collect_list("vec")).alias("vecs")))
    d, radius = grid.d, grid.radius

    def near(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["vecs"], b["ovecs"], strict=True):
                diff = np.reshape(x, (-1, 1, d)) - np.reshape(y, (1, -1, d))
                keep.append(bool((np.sqrt((diff ** 2).sum(-1)) <= radius).any()))
            yield b.loc[keep, ["cell", "other"]]
    tried = pairs.join(reps, "cell").join(reps.select(F.col("cell").alias("other"), F.col("vecs").alias("ovecs")), "other")
    sure = cut_lineage(tried.mapInPandas(near, "cell string, other string"))
    found = _components(cells, sure)
    named = found.withColumnsRenamed({"cell": "other", "component": "c2"})
    open_ = cut_lineage(pairs.join(found, "cell").join(named, "other").where("component <> c2").select("cell", "other"))
    if open_.isEmpty():
        return found

    def touch(mask, values):
        return {"near": mask.any(axis=1)}
    asked = core.select("cell", "vec").join(open_, "cell").select(F.col("cell").alias("id"), "vec", "other",
                                                                  F.lit(False).alias("whole"))
    more = grid.compare(asked, core, "m", touch, "id string, near boolean", keep="other")
    more = more.where("near").select(F.col("id").alias("cell"), "other").distinct()
    return _components(cells, sure.unionByName(more))


def _components(cells: DataFrame, edges: DataFrame) -> DataFrame:
    found = small_components(edges.select(F.col("cell").alias("a"), F.col("other").alias("b")))
    return cut_lineage(cells.select("cell").join(found.withColumnRenamed("node", "cell"), "cell", "left")
                       .select("cell", F.coalesce("component", "cell").alias("component")))


def dbscan(df: DataFrame, features: list[str], id_col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``(id, cluster)``: clusters are numbered by their smallest core row id, -1 is noise, null a row with nulls.

    Works on grid cells whose points are all within ``eps`` of each other: in a cell of ``min_samples`` rows every point
    is core, so only the few points of thinner cells are counted; clusters are components over cells; only points that
    aren't core look for a neighbouring cluster (the smallest number). No table of close pairs is made.
    """
    import numpy as np
    rows, pts, rest = _distinct_points(df, features, id_col)
    grid = _grid(pts, features, eps)
    cells = cut_lineage(grid.cells(F.sum("m").alias("total")))
    thick = cells.where(F.col("total") >= min_samples).select("cell")
    thin = cut_lineage(grid.points.join(thick, "cell", "left_anti"))
    counts = grid.count(thin.select("id", "vec"), "m").where(F.col("neighbours") >= min_samples).select("id")
    columns = ["id", "vec", "m", "least", "cell", "box"]
    core = cut_lineage(grid.points.join(thick, "cell", "left_semi").select(*columns)
                       .unionByName(thin.join(counts, "id", "left_semi").select(*columns)))
    linked = _linked_cells(grid, core)
    firsts = (core.groupBy("cell").agg(F.min("least").alias("least")).join(linked, "cell")
              .groupBy("component").agg(F.min("least").alias("least")))
    number = numbered(firsts, ["least"], "cluster").select("component", F.col("cluster").cast("int"))
    core = cut_lineage(core.join(linked.join(number, "component").select("cell", "cluster"), "cell"))

    def smallest(mask, values):
        low = np.where(mask, values[None, :], np.iinfo(np.int32).max).min(axis=1)
        return {"cluster": low.astype(np.int32)}
    edge = thin.join(core.select("id"), "id", "left_anti").select("id", "vec")
    homes = core.groupBy("cell").agg(F.first("box").alias("box"))
    kind = core.schema["id"].dataType.simpleString()
    border = (grid.compare(grid.meet(edge, homes), core, "cluster", smallest,
                           f"id {kind}, cluster int")
              .groupBy("id").agg(F.min("cluster").alias("cluster")).where(F.col("cluster") < (1 << 31) - 1))
    per_pt = core.select(F.col("id").alias("vk"), "cluster").unionByName(border.withColumnRenamed("id", "vk"))
    return (rows.join(per_pt, "vk", "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
            .unionByName(rest.select(F.col(id_col), F.lit(None).cast("int").alias("cluster"))))


def hclust(df: DataFrame, features: list[str], id_col: str, k: int = 4) -> DataFrame:
    """``(id, cluster)``: single linkage cut to ``k`` clusters, numbered by their smallest row id; null for rows with
    nulls. Exact: the edges of a minimum spanning tree, by ``models.linkage``. Equal rows are one point; of edges of
    equal length the later ones by their points' keys are cut first."""
    from tabwright.models.linkage import single_linkage
    rows, pts, rest = _distinct_points(df, features, id_col)
    found = single_linkage(pts.withColumnRenamed("vk", "id"), len(features), k)
    firsts = pts.join(found.withColumnRenamed("id", "vk"), "vk").groupBy("component").agg(F.min("least").alias("least"))
    number = numbered(firsts, ["least"], "cluster").select("component", F.col("cluster").cast("int"))
    out = rows.join(found.join(number, "component").select(F.col("id").alias("vk"), "cluster"), "vk")
    return out.select(F.col("id").alias(id_col), "cluster").unionByName(
        rest.select(F.col(id_col), F.lit(None).cast("int").alias("cluster")))


TILE, HALO = 16, 8      # side of a tile and width of the rim around it, in bandwidths
TILE_POINTS = 200_000  # points of a tile with its rim, at most


def _walked(pts: DataFrame, seeds: DataFrame, d: int, bw: float, rounds: int, tol: float) -> DataFrame | None:
    """Seeds (id, vec) after their rounds, as ``_stepped``, or None if a tile would hold too many points.

    Seeds don't meet each other, so a task walks those of a tile of the (at most three) widest dimensions through many
    rounds, among the tile's points and those of a rim around it; seeds that come near the rim's end are dealt anew. All stop
    in the first round in which none moves more than ``tol`` bandwidths, so a seed's path is kept until it stands still.
    """
    import numpy as np
    import pandas as pd
    wide = [F.approx_count_distinct(F.floor(F.col("vec")[j] / F.lit(bw))).alias(str(j)) for j in range(d)]
    spread = pts.agg(*wide).first()
    axes = sorted(range(d), key=lambda j: (-(spread[str(j)] or 0), j))[:3]
    side, rim = TILE * bw, HALO * bw

    def at(x):
        return F.floor(x / F.lit(side)).cast("long")
    held = pts.select(F.col("vec").alias("pvec"), "m")
    for i, j in enumerate(axes):
        x = F.col("pvec")[j]
        held = held.withColumn(f"t{i}", F.explode(F.sequence(at(x - rim), at(x + rim))))
    held = held.select(F.array(*[f"t{i}" for i in range(len(axes))]).alias("pt"), "pvec", "m")
    todo = seeds.select("id", "vec", F.lit(0).alias("made"))
    tile = F.array(*[at(F.col("vec")[j]) for j in axes])
    most = held.groupBy("pt").count().agg(F.max("count")).first()[0] or 0
    if most > TILE_POINTS:
        return None
    held = cut_lineage(held)

    def walk(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        out = {"id": [], "made": [], "moves": [], "path": [], "state": []}
        if len(qs):
            x = np.stack(qs["vec"].to_numpy()).astype(float)
            lo = np.array(qs["t"].iloc[0], float) * side - rim + bw
            hi = lo + side + 2 * rim - 2 * bw
            y = np.stack(ps["pvec"].to_numpy()).astype(float) if len(ps) else np.zeros((0, d))
            m = ps["m"].to_numpy(float)
            mass = np.column_stack([m, y * m[:, None]])
            made = qs["made"].to_numpy()
            paths, moves = [[] for _ in x], [[] for _ in x]
            state = np.zeros(len(x), int)  # 0: to be dealt anew, 1: stands still, 2: without points
            live = np.arange(len(x))
            step = max(1, (1 << 20) // max(len(y), 1))
            while len(live):
                total = np.zeros((len(live), d + 1))
                for s in range(0, len(live), step):
                    sq = np.zeros((len(live[s:s + step]), len(y)))
                    for j in range(d):
                        sq += (x[live[s:s + step], j, None] - y[None, :, j]) ** 2
                    total[s:s + step] = (np.sqrt(sq) <= bw).astype(float) @ mass
                some = total[:, 0] > 0
                state[live[~some]] = 2
                live, total = live[some], total[some]
                new = total[:, 1:] / total[:, :1]
                moved = np.sqrt(((new - x[live]) ** 2).sum(axis=1))
                x[live] = new
                for k, p, v in zip(live, new, moved):
                    paths[k].append(p.tolist())
                    moves[k].append(float(v))
                ended = (moved == 0) | (made[live] + np.array([len(paths[k]) for k in live], int) >= rounds)
                state[live[ended]] = 1
                inside = ((new[:, axes] >= lo) & (new[:, axes] <= hi)).all(axis=1)
                live = live[~ended & inside]
            out = {"id": qs["id"].to_numpy(), "made": made, "moves": moves, "path": paths, "state": state}
        return pd.DataFrame({c: pd.Series(list(v), dtype=object if c in ("id", "moves", "path") else "int64")
                             for c, v in out.items()})
    pieces = None
    while not todo.isEmpty():
        asked = todo.withColumn("t", tile)
        piece = cut_lineage(asked.groupBy("t").cogroup(held.groupBy("pt")).applyInPandas(
            walk, "id string, made int, moves array<double>, path array<array<double>>, state int"))
        pieces = piece if pieces is None else pieces.unionByName(piece)
        todo = piece.where("state = 0").select("id", F.element_at("path", -1).alias("vec"),
                                               (F.col("made") + F.size("path")).alias("made"))
    if pieces is None:
        return seeds
    largest = {r["t"]: r["m"] for r in pieces.select("made", F.posexplode("moves").alias("p", "move")).groupBy(
        (F.col("made") + F.col("p") + 1).alias("t")).agg(F.max("move").alias("m")).collect()}  # a row per round
    last = next((t for t in range(1, rounds + 1) if largest.get(t, 0.0) <= tol * bw), rounds)
    ends = pieces.groupBy("id").agg(
        F.max(F.when(F.col("state") == 2, F.col("made") + F.size("path") + 1)).alias("gone"),
        F.max(F.when((F.col("made") < last) & (F.size("path") > 0), F.struct("made", "path"))).alias("at"))
    ends = ends.where(F.col("gone").isNull() | (F.col("gone") > last))
    return cut_lineage(ends.select("id", F.element_at(
        "at.path", F.least(F.lit(last) - F.col("at.made"), F.size("at.path"))).alias("vec")))


def _stepped(pts: DataFrame, seeds: DataFrame, d: int, bw: float, rounds: int, tol: float) -> DataFrame:
    """Seeds (id, vec) after their rounds, one after the other over all points."""
    # what a mean needs of a point: its multiplicity, and that times its vector
    mass = F.concat(F.array(F.col("m").cast("double")), F.transform("vec", lambda x: x * F.col("m")))
    grid = Grid(pts.select(F.col("vk").alias("id"), "vec", mass.alias("mass")), d, bw)
    cells = cut_lineage(grid.cells().select("cell", "box"))

    def summed(mask, values):
        return {"mass": list(mask.astype(float) @ values)}
    for _ in range(rounds):
        part = grid.compare(grid.meet(seeds, cells, few=True), grid.points, "mass", summed, "id string, mass array<double>")
        total = part.groupBy("id").agg(*[F.sum(F.col("mass")[j]).alias(f"s{j}") for j in range(d + 1)])
        new = cut_lineage(total.where("s0 > 0").select(
            "id", F.array(*[F.col(f"s{j}") / F.col("s0") for j in range(1, d + 1)]).alias("vec")))
        # stop once no seed moves more than tol * bandwidth
        shift = (new.join(seeds.withColumnRenamed("vec", "old"), "id")
                 .agg(F.max(F.sqrt(F.aggregate(F.zip_with("vec", "old", lambda a, b: (a - b) * (a - b)),
                                               F.lit(0.0), lambda s_, v_: s_ + v_)))).first()[0])
        seeds = new
        if shift is None or shift <= tol * bw:
            break
    return seeds


def meanshift(df: DataFrame, features: list[str], id_col: str, bandwidth: float | None = None,
              rounds: int = 300, tol: float = 1e-3) -> DataFrame:
    """``(id, cluster)``: flat-kernel mean shift from binned seeds; a row gets its nearest mode, rows with nulls null.

    A seed's mean is taken over the points of its tile, many rounds in a task, or, where tiles would hold too many points, round by
    round over whole grid cells by their totals and the points of cells its ball cuts.
    """
    rows, pts, rest = _distinct_points(df, features, id_col)
    d = len(features)
    v = pts.select(F.col("vk").alias("id"), "vec")
    if bandwidth is None:
        nb = knn_join(_vec(df, features, id_col).join(rest.withColumnRenamed(id_col, "id"), "id", "left_anti"),
                      None, 5, "id", "vec")
        bandwidth = quantile_dict(nb, ["dist"], [0.3]).get(("dist", 0.3)) or 1.0
        bandwidth *= 3.0
    bw = float(bandwidth)
    seeds = cut_lineage(v.select(F.transform("vec", lambda x: F.floor(x / F.lit(bw)) * F.lit(bw)).alias("vec")).distinct()
                        .withColumn("id", F.md5(F.to_json("vec"))))
    found = _walked(pts, seeds, d, bw, rounds, tol)
    seeds = _stepped(pts, seeds, d, bw, rounds, tol) if found is None else found
    half = bw / 2.0
    modes = (seeds.select(F.transform("vec", lambda x: F.round(x / F.lit(half)) * F.lit(half)).alias("vec"))
             .distinct().withColumn("id", F.md5(F.to_json("vec"))))
    modes = cut_lineage(modes)
    nn = knn_join(v, modes, 1, "id", "vec", exclude_self=False)
    idx = numbered(modes.select("id"), ["id"], "cluster").select(F.col("id").alias("nid"), F.col("cluster").cast("int"))
    per_pt = nn.join(idx, "nid").select(F.col("qid").alias("vk"), "cluster")
    return rows.join(per_pt, "vk").select(F.col("id").alias(id_col), "cluster").unionByName(
        rest.select(F.col(id_col), F.lit(None).cast("int").alias("cluster")))


AP_CUT = 5  # rounds of affinity propagation between two checkpoints


def affinity_propagation(df: DataFrame, features: list[str], id_col: str, n_neighbors: int | None = None,
                         rounds: int = 50, damping: float = 0.5) -> DataFrame:
    """``(id, cluster)``: all rows are candidates of all rows unless ``n_neighbors`` leaves only a row's nearest ones."""
    rest = incomplete(df, features).select(F.col(id_col), F.lit(None).cast("int").alias("cluster"))
    v = _vec(df, features, id_col).where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))
    if n_neighbors is None:
        from tabwright.models.affinity import label_rows
        return label_rows(v, rounds, damping).withColumnRenamed("id", id_col).unionByName(rest)
    nb = knn_join(v, None, n_neighbors, "id", "vec")
    s = nb.select(F.col("qid").alias("i"), F.col("nid").alias("k"), (-(F.col("dist") ** 2)).alias("s"))
    pref = quantile_dict(s, ["s"], [0.5]).get(("s", 0.5)) or -1.0
    selfs = v.select(F.col("id").alias("i"), F.col("id").alias("k"), F.lit(pref).alias("s"))
    e = (s.unionByName(selfs).where(F.col("i").isNotNull() & F.col("k").isNotNull())
         .withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0)))
    of_i, of_k = Window.partitionBy("i"), Window.partitionBy("k")
    as_, gain = F.col("a") + F.col("s"), F.greatest("r", F.lit(0.0))
    for t in range(rounds):
        # responsibility r(i,k) = s(i,k) - max_{k' != k} (a(i,k') + s(i,k'))
        e = e.withColumn("m1", F.max(as_).over(of_i)).withColumn("t1", F.max_by("k", as_).over(of_i))
        e = e.withColumn("m2", F.max(F.when(F.col("k") != F.col("t1"), as_)).over(of_i))
        other = F.when(F.col("k") == F.col("t1"), F.coalesce("m2", F.lit(-1e300))).otherwise(F.col("m1"))
        e = e.select("i", "k", "s", "a", (F.lit(damping) * F.col("r") + F.lit(1 - damping) * (F.col("s") - other)).alias("r"))
        # availability a(i,k) = min(0, r(k,k) + sum_{i' not in {i,k}} max(0, r(i',k))); a(k,k) = sum_{i' != k} max(0, r(i',k))
        e = (e.withColumn("sp", F.coalesce(F.sum(F.when(F.col("i") != F.col("k"), gain)).over(of_k), F.lit(0.0)))
             .withColumn("rkk", F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).over(of_k)))
        a_off = F.least(F.lit(0.0), F.coalesce("rkk", F.lit(0.0)) + F.col("sp") - gain)
        a_new = F.when(F.col("i") == F.col("k"), F.col("sp")).otherwise(a_off)
        e = e.select("i", "k", "s", "r", (F.lit(damping) * F.col("a") + F.lit(1 - damping) * a_new).alias("a"))
        # a round reads the one before once, two shuffles of the edges: the plan is a chain and is cut now and then
        if t % AP_CUT == AP_CUT - 1 or t == rounds - 1:
            e = cut_lineage(e)
    ex = e.where((F.col("i") == F.col("k")) & (F.col("r") + F.col("a") > 0)).select(F.col("k").alias("ex"))
    cand = e.join(ex.withColumnRenamed("ex", "k"), "k", "left_semi")
    best = cand.groupBy("i").agg(F.max_by("k", "s").alias("exemplar"))
    idx = numbered(ex, ["ex"], "cluster").select("ex", F.col("cluster").cast("int"))
    lab = v.select(F.col("id").alias("i")).join(best, "i", "left").join(idx, F.col("exemplar") == F.col("ex"), "left")
    return lab.select(F.col("i").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster")).unionByName(rest)


CLUSTERERS = {
    "kmeans": lambda df, f, i, **kw: kmeans(df, f, i, **kw),
    "hclust": hclust,
    "sc": spectral, "dbscan": dbscan, "meanshift": meanshift, "ap": affinity_propagation,
}


def silhouette(assign: DataFrame, df: DataFrame, features: list[str], id_col: str) -> float | None:
    """Spark ML silhouette (squared Euclidean) of an assignment; None when undefined."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    x = VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="skip").transform(
        df.select(id_col, *features)).join(assign, id_col).where(F.col("cluster") >= 0)
    if x.select("cluster").distinct().limit(2).count() < 2:
        return None
    return float(ClusteringEvaluator(featuresCol="__f", predictionCol="cluster").evaluate(
        x.withColumn("cluster", F.col("cluster").cast("double"))))
