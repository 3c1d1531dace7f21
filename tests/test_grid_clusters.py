"""Grid searches, DBSCAN, mean shift and single linkage against plain versions; rows with nulls stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.models import cluster as C
from tabwright.models import linkage as L
from tabwright.operators.grid import Grid


def places(seed=0, n=160):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.4, (n // 2, 2)), rng.normal((4, 4), 0.3, (n // 4, 2)),
                        rng.uniform(-3, 8, (n // 4, 2))])
    x[: n // 8] = x[0]  # equal rows
    return x


@pytest.fixture(scope="module")
def table(spark):
    x = places()
    rows = [(int(i * 7 % 1009), float(a), float(b)) for i, (a, b) in enumerate(x)]
    extra = [(2001, None, 1.0), (2002, float("nan"), 1.0), (2003, None, None)]
    return rows, spark.createDataFrame(rows + extra, "id long, a double, b double").repartition(5).cache()


def plain_dbscan(rows, eps, least):
    rows = sorted(rows)
    x = np.array([r[1:] for r in rows])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    count = near.sum(1)
    core = count >= least
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], k
            while todo:
                for t in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[t] = k
                    todo.append(t)
            k += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    ids = [r[0] for r in rows]
    return dict(zip(ids, map(int, count), strict=True)), dict(zip(ids, map(int, label), strict=True))


@pytest.mark.parametrize("eps, least", [(0.3, 4), (1.0, 9)])
def test_dbscan_is_the_plain_one(spark, table, eps, least, monkeypatch):
    rows, df = table
    monkeypatch.setattr(C, "REPS", 1)  # most cells are then compared whole
    count, label = plain_dbscan(rows, eps, least)
    got = {r["id"]: r["cluster"] for r in C.dbscan(df, ["a", "b"], "id", eps, least).collect()}
    assert got == label | {2001: None, 2002: None, 2003: None}
    flags = {r["id"]: r["neighbours"] for r in C.core_flags(df, ["a", "b"], "id", eps, least).collect()}
    assert flags == count | {2001: None, 2002: None, 2003: None}


def test_no_table_of_pairs(spark):
    """Ten times the rows in the same place: points are counted by cell totals, not paired."""
    one = spark.range(20_000).select(F.col("id"), (F.col("id") % 100 / 1e4).alias("a"), (F.col("id") / 1e7).alias("b"))
    got = C.dbscan(one, ["a", "b"], "id", 0.5, 5)
    assert got.groupBy("cluster").count().collect() == [(0, 20_000)]
    assert "cartesian" not in got._jdf.queryExecution().toString().lower()


def test_grid_counts_in_three_dimensions(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(250, 3)), 1)  # many distances equal to the radius
    df = spark.createDataFrame([(i, [float(v) for v in p], 1) for i, p in enumerate(x)], "id long, vec array<double>, m int")
    grid = Grid(df, 3, 0.5)
    got = {r["id"]: r["neighbours"] for r in grid.count(grid.points.select("id", "vec"), "m").collect()}
    want = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5).sum(1)
    assert got == dict(enumerate(map(int, want)))


def plain_linkage(x, k):
    n = len(x)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    edges = sorted((dist[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    left = n
    for _, i, j in edges:
        if left == k:
            break
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            left -= 1
    names: dict = {}
    return [names.setdefault(top(i), len(names)) for i in range(n)]


@pytest.mark.parametrize("k, few", [(5, 100_000), (3, 0)])
def test_hclust_is_single_linkage(spark, k, few, monkeypatch):
    monkeypatch.setattr(L, "FEW_EDGES", few)  # 0: Borůvka rounds as Spark jobs
    x = np.random.default_rng(k).normal(size=(120 if few else 40, 2))
    x[5] = x[4]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 0.0)],
                               "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in C.hclust(df, ["a", "b"], "id", k).collect()}
    assert got == dict(enumerate(plain_linkage(x, k))) | {900: None}


def test_meanshift_and_others_keep_rows_with_nulls(spark, table):
    rows, df = table
    got = C.meanshift(df, ["a", "b"], "id", bandwidth=1.5)
    assert dict(got.dtypes) == {"id": "bigint", "cluster": "int"}
    found = {r["id"]: r["cluster"] for r in got.collect()}
    assert len(found) == len(rows) + 3 and all(found[i] is None for i in (2001, 2002, 2003))
    # the two dense places have a mode each
    assert found[rows[0][0]] == found[rows[30][0]] != found[rows[90][0]]
    sc = {r["id"]: r["cluster"] for r in C.spectral(df, ["a", "b"], "id", k=2, n_neighbors=5).collect()}
    assert len(sc) == len(rows) + 3 and sc[2001] is None


@pytest.mark.parametrize("bw, tile, halo", [(0.7, 16, 8), (0.4, 2, 2), (2.5, 1, 2)])
def test_seeds_of_a_tile_walk_as_step_by_step(spark, bw, tile, halo, monkeypatch):
    """Small tiles: seeds leave them and are dealt anew. Some seeds have no point in reach."""
    monkeypatch.setattr(C, "TILE", tile)
    monkeypatch.setattr(C, "HALO", halo)
    x = places(3, 200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    _, pts, _ = C._distinct_points(df, ["a", "b"], "id")
    seeds = spark.createDataFrame([(f"{i}{j}", [i * bw, j * bw]) for i in range(-4, 9, 3) for j in range(-3, 9, 2)],
                                  "id string, vec array<double>").cache()
    got = {r["id"]: r["vec"] for r in C._walked(pts, seeds, 2, bw, 300, 1e-3).collect()}
    at, points = {r["id"]: np.array(r["vec"]) for r in seeds.collect()}, x
    for _ in range(300):
        new = {}
        for i, c in at.items():
            near = points[np.sqrt(((points - c) ** 2).sum(1)) <= bw]
            if len(near):
                new[i] = near.mean(0)
        shift = max(np.sqrt(((new[i] - at[i]) ** 2).sum()) for i in new)
        at = new
        if shift <= 1e-3 * bw:
            break
    assert sorted(got) == sorted(at) and len(at) < seeds.count() or bw == 2.5
    np.testing.assert_allclose([got[i] for i in sorted(got)], [at[i] for i in sorted(at)], atol=1e-9)


def test_tiles_of_many_points_go_step_by_step(spark, table, monkeypatch):
    _, df = table
    walked = {tuple(r) for r in C.meanshift(df, ["a", "b"], "id", bandwidth=1.5).collect()}
    monkeypatch.setattr(C, "TILE_POINTS", 10)
    assert {tuple(r) for r in C.meanshift(df, ["a", "b"], "id", bandwidth=1.5).collect()} == walked
