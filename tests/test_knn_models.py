import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import knn
from tabwright.operators.knn import knn_join, range_join
from tabwright.operators.neighbors import smote

SF = "/root/testdata/sf0.001"


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(300)], "id long, vec array<double>")
    got = {(r.qid, r["rank"]): r.nid for r in knn_join(df, k=4, bucket_rows=20).collect()}
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for i in range(300):
        order = sorted(range(300), key=lambda j: (D[i, j], j))[:4]
        assert [got[(i, r + 1)] for r in range(4)] == order


def test_range_join_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(200)], "id long, vec array<double>")
    got = {(r.qid, r.nid) for r in range_join(df, eps=0.7).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    want = {(i, j) for i in range(200) for j in range(200) if D[i, j] <= 0.7}
    assert got == want


def test_smote_points_between_parents(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), 0) for i, (x, y) in enumerate(rng.normal(size=(95, 2)))]
    rows += [(100 + i, float(x) + 10, float(y) + 10, 1) for i, (x, y) in enumerate(rng.normal(size=(5, 2)) * 0.1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = smote(df, "y", ["a", "b"], "id")
    syn = out.where("synthetic").collect()
    assert len(syn) == 90
    assert all(9 < r.a < 11 and 9 < r.b < 11 for r in syn)


def test_linear_models_recover_coefficients(spark):
    from tabwright.models.linear import GramRegressor
    from tabwright.sources.jdbc import make_regression
    df = make_regression(spark, n=2000, d=5, informative=3, noise=0.0, seed=1)
    feats = [f"x{i}" for i in range(5)]
    for mid in ("lr", "lar", "omp", "br"):
        f = GramRegressor(mid, "regression", "").fit(df, feats, "target")
        pred = f.transform(df).select(F.max(F.abs(F.col("target") - F.col("prediction")))).first()[0]
        if mid != "omp":
            assert pred < 1e-6, mid


def test_experiment_save_load_same_predictions(spark, tmp_path):
    from tabwright.config import RunConfig
    from tabwright.plans.experiment import Experiment, load_model
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                              "l_extendedprice", "l_quantity", "l_discount")
    ex = Experiment(li, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                    RunConfig("regression", folds=2)).setup()
    f = ex.create_model("lr")
    p1 = sorted(round(r.prediction, 6) for r in ex.predict(f).collect())
    path = str(tmp_path / "m")
    ex.save_model(f, path)
    g, cfg, _ = load_model(spark, path)
    p2 = sorted(round(r.prediction, 6) for r in g.transform(ex.transform(ex.holdout)).collect())
    assert p1 == p2 and cfg["target"] == "l_extendedprice"
    assert "api_key" not in str(cfg)


def test_model_beats_constant_on_signal(spark):
    from tabwright.config import RunConfig
    from tabwright.plans.experiment import Experiment
    from tabwright.sources.jdbc import make_regression
    df = make_regression(spark, n=600, d=4, informative=4, noise=0.1, seed=3)
    ex = Experiment(df, "target", ["id"], RunConfig("regression", folds=2)).setup()
    board = {r.model: r for r in ex.compare_models(include=["lr", "dt"]).collect()}
    assert board["lr"]["r2"] > 0.99


def test_unknown_problem(spark):
    from tabwright.config import RunConfig
    with pytest.raises(ValueError):
        RunConfig("forecasting")


def test_knn_with_hot_duplicate_vector(spark):
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(size=(200, 3)), 1)
    X[:70] = X[0]  # a third of the rows share one vector
    X[100:103] = X[100]
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(200)], "id long, vec array<double>")
    got = {(r.qid, r["rank"]): (r.nid, r.dist) for r in knn_join(df, k=4, bucket_rows=16).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for i in range(200):
        order = sorted((j for j in range(200) if j != i), key=lambda j: (D[i, j], j))[:4]
        for r, j in enumerate(order):
            nid, dist = got[(i, r + 1)]
            assert nid == j or abs(dist - D[i, j]) < 1e-9
        if i < 70:  # own copies first, smallest ids first
            assert [got[(i, r + 1)][0] for r in range(4)] == [j for j in range(70) if j != i][:4]


def test_knn_against_reference_with_duplicates(spark):
    rng = np.random.default_rng(6)
    R = np.round(rng.normal(size=(150, 2)), 1)
    R[:60] = R[0]  # a hot repeated reference vector
    Q = np.round(rng.normal(size=(40, 2)), 1)
    ref = spark.createDataFrame([(i, [float(v) for v in R[i]]) for i in range(150)], "id long, vec array<double>")
    qs = spark.createDataFrame([(1000 + i, [float(v) for v in Q[i]]) for i in range(40)], "id long, vec array<double>")
    got = {(r.qid, r["rank"]): (r.nid, r.dist) for r in knn_join(qs, ref, k=3, exclude_self=False).collect()}
    D = np.sqrt(((Q[:, None, :] - R[None, :, :]) ** 2).sum(-1))
    for i in range(40):
        order = sorted(range(150), key=lambda j: (D[i, j], j))[:3]
        for r, j in enumerate(order):
            nid, dist = got[(1000 + i, r + 1)]
            assert nid == j or abs(dist - D[i, j]) < 1e-9


def test_blocks_stay_small_at_one_pivot_distance(spark, monkeypatch):
    """Points that all have one distance to the first pivots still lie in blocks of bounded size."""
    from pyspark.sql import functions as F
    from tabwright.operators import knn as K
    monkeypatch.setattr(K, "STRIP_ROWS", 40)
    monkeypatch.setattr(K, "BLOCK_ROWS", 50)
    same = spark.range(1000).select(F.col("id").alias("nid"), F.array(F.lit(0.0)).alias("__v"),
                                    F.array(F.lit(1.0), F.lit(2.0)).alias("__pd"), F.lit(0).alias("__g"))
    rows, boxes, _ = K._blocks(same, 2)
    sizes = [r["count"] for r in rows.groupBy("__b").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 150 and len(sizes) == boxes.count() == 20
    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * np.pi, 700)
    x = np.concatenate([[[0.0, 0.0]], np.stack([np.cos(angle), np.sin(angle)], 1)])  # a circle around one point
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    got = {(r["qid"], r["rank"]): r["dist"] for r in knn_join(df, k=3, bucket_rows=64).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    assert len(got) == len(x) * 3
    assert all(abs(got[i, j + 1] - want[i, j]) < 1e-9 for i in range(len(x)) for j in range(3))


def test_many_dimensions_meet_in_large_blocks(spark, monkeypatch):
    """Random vectors of many dimensions: boxes leave nothing out, so all pairs of a few large blocks are compared."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[7] = x[11]
    x[2999] = np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    taken = []
    whole = knn._all_blocks
    monkeypatch.setattr(knn, "_large_blocks", lambda n: 3)
    monkeypatch.setattr(knn, "_all_blocks", lambda *a: taken.append(a) or whole(*a))
    got = {(r["qid"], r["rank"]): (r["nid"], r["dist"])
           for r in knn.knn_join(df, None, 4, bucket_rows=64, dedupe=False).collect()}
    assert taken
    sq = np.zeros((len(x), len(x)))
    for j in range(x.shape[1]):
        sq += (x[:, None, j] - x[None, :, j]) ** 2
    dist = np.sqrt(sq)
    np.fill_diagonal(dist, np.inf)
    for i in range(len(x) - 1):
        at = np.lexsort((np.arange(len(x)), dist[i]))[:4]
        assert [got[i, t + 1] for t in range(4)] == [(int(n), dist[i, n]) for n in at]
    assert len(got) == 4 * (len(x) - 1)


def test_searches_of_other_blocks_are_dealt_by_number(spark, monkeypatch):
    """Queries that look for other blocks go to tasks by their number, however few bytes they have."""
    x = np.random.default_rng(6).normal(size=(900, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").coalesce(1)
    monkeypatch.setattr(knn, "PROBE", 100)
    stored = []
    cut = knn.cut_lineage
    monkeypatch.setattr(knn, "cut_lineage", lambda d: stored.append(cut(d)) or stored[-1])
    got = {(r["qid"], r["rank"]): r["nid"] for r in knn.knn_join(df, None, 3, bucket_rows=50, dedupe=False).collect()}
    asked = [d for d in stored if {"__rad", "__b"} <= set(d.columns)]
    assert asked and asked[0].rdd.getNumPartitions() >= 9
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    assert all([got[i, t + 1] for t in range(3)] == np.argsort(dist[i])[:3].tolist() for i in range(900))


def test_blocks_shuffle_every_vector_once(spark):
    """Looking up a query's block and its chunks shuffles no vectors, and large blocks make few copies."""
    rows = [(i, [float(i), 0.0], "a") for i in range(6)]
    q = spark.createDataFrame(rows, "qid long, __v array<double>, __b string")
    r = spark.createDataFrame(rows, "nid long, __rv array<double>, __b string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = knn._block_topk(q, r, 1, True, ("bigint", "bigint"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 0
        assert sorted((x.qid, x.nid) for x in found.collect()) == [(0, 1), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert knn._large_blocks(100_000) == 4
    assert knn._large_blocks(1_000_000) == 16
