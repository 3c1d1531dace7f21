"""Every catalogue model fits and scores once (small data, small iteration counts)."""

import pytest
from pyspark.sql import functions as F

from tabwright.config import PrepConfig, RunConfig
from tabwright.models.catalog import models
from tabwright.plans.experiment import Experiment, load_experiment
from tabwright.sources.jdbc import make_regression

SMALL = {"mlp": {"max_iter": 3, "maxIter": 5}, "ada": {"n_estimators": 3}, "rf": {"numTrees": 5},
         "et": {"numTrees": 5}, "gbr": {"maxIter": 5}, "gbc": {"maxIter": 5}, "tr": {"max_subpopulation": 50},
         "ransac": {"max_trials": 10}, "svm": {"steps": 5, "maxIter": 10}}


def test_every_regression_model(spark):
    df = make_regression(spark, n=300, d=3, informative=3, noise=1.0, seed=4)
    ex = Experiment(df, "target", ["id"], RunConfig("regression", folds=2)).setup()
    ids = list(models("regression"))
    board = {r.model: r for r in ex.compare_models(include=ids, params={m: SMALL.get(m, {}) for m in ids}).collect()}
    errors = {m: r.error for m, r in board.items() if r.error}
    assert not errors, errors
    assert board["lr"].r2 > 0.9


@pytest.mark.parametrize("problem", ["regression", "classification"])
def test_models_come_back_with_their_preparation(spark, tmp_path, problem):
    """Saved, loaded and applied to raw rows with gaps and text columns: the same predictions."""
    df = make_regression(spark, n=150, d=3, informative=3, noise=1.0, seed=4)
    df = df.withColumn("x1", F.when(F.col("id") % 9 != 0, F.col("x1"))).withColumn(
        "kind", F.concat(F.lit("k"), (F.col("id") % 3).cast("string"))).withColumn(
        "name", F.concat(F.lit("n"), (F.col("id") % 40).cast("string")))
    if problem == "classification":
        df = df.withColumn("target", F.when(F.col("target") > 0, "pos").otherwise("neg"))
    method = "iterative" if problem == "regression" else "knn"
    ex = Experiment(df, "target", ["id"], RunConfig(problem, folds=2),
                    PrepConfig(imputation=method, normalization="zscore")).setup()
    raw = df.where("id % 4 = 0").drop("target")
    kinds = {"regression": ["lr", "kr", "knn", "ada", "rf", "mlp"],
             "classification": ["lr", "knn", "nb", "qda", "ada", "rbfsvm"]}  # one of every way to store a model
    for mid in kinds[problem]:
        path = str(tmp_path / mid)
        f = ex.create_model(mid, **SMALL.get(mid, {}))
        want = {r.id: r.prediction for r in ex.predict(f, raw).collect()}
        ex.save_model(f, path)
        back, g = load_experiment(spark, path)
        got = {r.id: r.prediction for r in back.predict(g, raw).collect()}
        assert len(got) == raw.count() and got == pytest.approx(want), mid


def test_every_classification_model(spark):
    df = make_regression(spark, n=300, d=3, informative=3, noise=1.0, seed=5)
    df = df.withColumn("cls", F.when(F.col("target") > 0, "pos").otherwise("neg")).drop("target")
    ex = Experiment(df, "cls", ["id"], RunConfig("classification", folds=2)).setup()
    ids = list(models("classification"))
    board = {r.model: r for r in ex.compare_models(include=ids, params={m: SMALL.get(m, {}) for m in ids}).collect()}
    errors = {m: r.error for m, r in board.items() if r.error}
    assert not errors, errors
    assert board["lda"].accuracy > 0.8
