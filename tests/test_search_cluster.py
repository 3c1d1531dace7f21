import json

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reg_exp(spark):
    from tabwright.config import RunConfig
    from tabwright.plans.experiment import Experiment
    from tabwright.sources.jdbc import make_regression
    df = make_regression(spark, n=400, d=4, informative=3, noise=0.5, seed=9)
    return Experiment(df, "target", ["id"], RunConfig("regression", folds=2)).setup()


@pytest.mark.parametrize("search", ["grid", "random", "bayesian", "tpe", "default"])
def test_search_strategies(reg_exp, search):
    from tabwright.plans.search import tune
    grid = {"alpha": [0.01, 1.0, 100.0]} if search == "grid" else None
    res = tune(reg_exp, "ridge", search, grid=grid, n_iter=4)
    rows = res.trials.collect()
    assert rows and all(json.loads(r.params) for r in rows)
    assert res.best_params and res.best_score == max(r.score for r in rows if r.score is not None)


def test_custom_grid_json_and_dropped(reg_exp):
    from tabwright.plans.search import merge_grid, translate
    g = merge_grid("rf", '{"n_estimators": [10, 20]}')
    assert g["n_estimators"] == [10, 20] and "max_depth" in g
    p, dropped = translate("rf", {"n_estimators": 10, "max_depth": None, "min_samples_split": 2}, 100)
    assert p == {"numTrees": 10, "maxDepth": 30} and dropped == ["min_samples_split"]
    with pytest.raises(ValueError):
        merge_grid("rf", {"n_estimators": 5})


def test_hints(spark):
    from tabwright.plans.search import hints
    board = spark.createDataFrame([("rf", 0.7), ("svm", 0.85)], "model string, accuracy double")
    h = hints(board, "accuracy", target=0.9).collect()
    rf = [r.hint for r in h if r.model == "rf"]
    assert any("n_estimators" in x for x in rf) and any("ensemble" in x for x in rf)
    assert any("Fine-tune" in r.hint for r in h if r.model == "svm")


def test_clusterers_label_every_row(spark):
    from tabwright.models import cluster as C
    from tabwright.operators import prep
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey")
    c = prep.scale(c, "zscore", exclude=["c_custkey"])
    for mid in ("kmeans", "hclust", "dbscan"):
        out = C.CLUSTERERS[mid](c, ["c_acctbal", "c_nationkey"], "c_custkey")
        assert out.count() == 150 and out.select("c_custkey").distinct().count() == 150


def test_iterative_impute_fills(spark):
    from tabwright.operators.impute_model import iterative_impute
    from tabwright.sources.jdbc import make_regression
    df = make_regression(spark, n=300, d=3, informative=3, noise=0.0, seed=2)
    holed = df.withColumn("x0", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("x0")))
    out = iterative_impute(holed, ["x0", "x1", "x2", "target"], rounds=3)
    assert out.where(F.col("x0").isNull()).count() == 0
    err = out.join(df.select("id", F.col("x0").alias("t")), "id").where(F.col("id") % 5 == 0).agg(
        F.max(F.abs(F.col("x0") - F.col("t")))).first()[0]
    assert err < 1e-3  # the target is an exact linear function of the features


def test_topics_cover_all_documents(spark):
    from tabwright.models.text import TOPIC_MODELS
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    n = d.count()
    for mid in ("lda", "rp"):
        t = TOPIC_MODELS[mid](d, "text", "doc_id")
        assert t.select("doc_id").distinct().count() == n


def test_config_roundtrip_drops_secrets():
    from dataclasses import dataclass
    from tabwright.config import RunConfig, from_json, to_json
    cfg = RunConfig("regression", folds=3, models=("lr", "rf"))
    back = from_json(RunConfig, to_json(cfg).replace("}", ', "unknown_key": 1}'))
    assert back == cfg

    @dataclass(frozen=True)
    class WithKey:
        api_key: str = "x"
        folds: int = 2
    assert "api_key" not in to_json(WithKey())


def test_grids_translate_without_repeats_and_unknown_names_raise():
    import pytest

    from tabwright.plans.search import merge_grid, translate
    assert translate("mlp", {"hidden_layer_sizes": (50,), "alpha": 0.1}, 10, "regression") == ({"hidden": 50, "alpha": 0.1}, [])
    assert translate("mlp", {"hidden_layer_sizes": (100, 50)}, 10, "regression")[1] == ["hidden_layer_sizes[1:]"]
    with pytest.raises(ValueError):
        merge_grid("rf", {"n_estimater": [1]})
    assert merge_grid("rf", '{"maxDepth": [2]}')["maxDepth"] == [2]


def test_knn_training_rows_all_vote(spark):
    from tabwright.models.catalog import get_model
    rows = [(0.0, 0)] * 3 + [(0.1, 1)] * 2 + [(9.0, 1)] * 5
    df = spark.createDataFrame(rows, "x double, y int")
    m = get_model("classification", "knn").with_params(n_neighbors=5).fit(df, ["x"], "y")
    assert m.train.count() == 10
    assert m.transform(spark.createDataFrame([(0.02,)], "x double")).first()["prediction"] == 0
