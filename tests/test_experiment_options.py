import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _li(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").select(
        *KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@pytest.mark.parametrize("prep", [
    dict(imbalance="smote", feature_selection="univariate", n_features=0.5),
    dict(imbalance="randomunder", remove_outliers=True, outlier_threshold=0.05, sample_pct=50.0),
    dict(imputation="median", normalization="robust", feature_selection="rfe", n_features=0.5),
])
def test_classification_options_run(spark, prep):
    from tabwright.config import PrepConfig, RunConfig
    from tabwright.plans.experiment import Experiment
    ex = Experiment(_li(spark), "l_returnflag", KEY, RunConfig("classification", folds=2), PrepConfig(**prep)).setup()
    board = ex.compare_models(include=["lda", "nb"])
    rows = board.collect()
    assert len(rows) == 2 and all(r.error is None for r in rows), [r.error for r in rows]
    assert all(0.0 <= r.accuracy <= 1.0 for r in rows)
    if prep.get("feature_selection"):
        assert 1 <= len(ex.features) <= 4


def test_unsupervised_compare_and_errors_as_rows(spark):
    from tabwright.plans.experiment import compare_unsupervised
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey", "c_acctbal", "c_nationkey")
    cl = compare_unsupervised(c, ["c_acctbal", "c_nationkey"], "c_custkey", "clustering", include=["kmeans", "nope"])
    got = {r.model: r for r in cl.collect()}
    assert got["kmeans"].error is None and got["kmeans"].n_clusters == 4
    assert got["nope"].error is not None
    an = compare_unsupervised(c, ["c_acctbal", "c_nationkey"], "c_custkey", "anomaly", include=["histogram"])
    r = an.first()
    assert r.error is None and r.outliers <= 150 * 0.05 + 1
