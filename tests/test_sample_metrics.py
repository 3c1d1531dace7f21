import pytest
from pyspark.sql import functions as F

from tabwright.operators import metrics as M
from tabwright.operators import sample as S


def test_exact_sample_size_and_stability(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3).cast("string"))
    a = S.random_sample(df, 10, ["id"])
    b = S.random_sample(df.repartition(7), 10, ["id"])
    assert a.count() == 100
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())


def test_stratified_quota(spark):
    df = spark.range(1000).withColumn("y", F.when(F.col("id") < 900, "a").otherwise("b"))
    s = S.stratified_sample(df, "y", 10, ["id"])
    got = {r.y: r["count"] for r in s.groupBy("y").count().collect()}
    assert got == {"a": 90, "b": 10}


def test_rank_cutoff_refines_large_groups(spark):
    from tabwright.functions.columns import md5_order
    from tabwright.functions.ranks import select_first
    df = spark.range(5000)
    s = select_first(df, md5_order(["id"], 1), [], {(): 1234}, [], window_limit=100)
    assert s.count() == 1234


def test_folds_balanced(spark):
    df = S.kfold(spark.range(5000), ["id"], 5)
    sizes = [r["count"] for r in df.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and all(900 < s < 1100 for s in sizes)


def test_undersample(spark):
    df = spark.range(100).withColumn("y", (F.col("id") < 5).cast("int"))
    got = {r.y: r["count"] for r in S.undersample(df, "y", ["id"]).groupBy("y").count().collect()}
    assert got == {0: 5, 1: 5}


def test_metrics_zero_division_and_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (0, 0)], "label int, prediction int")
    rep = {r["cls"]: r for r in M.class_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["0"]["recall"] == 1.0
    m = M.classification_metrics(df).first()
    assert m["accuracy"] == 0.5 and m["kappa"] == 0.0


def test_auc_ties(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, False), (0.9, True), (0.1, False)], "score double, is_pos boolean")
    assert M.auc(df).first()["auc"] == pytest.approx(0.875)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    r = M.regression_metrics(df).first()
    assert r["mae"] == 0.5 and r["mse"] == 0.5 and r["r2"] == pytest.approx(1 - 0.5 / 0.25)


def test_running_totals_match_pandas(spark):
    import numpy as np
    import pandas as pd
    from tabwright.functions.running import running_totals
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "k": rng.integers(0, 400, 3000).astype(float),
                        "x": rng.integers(0, 5, 3000)})
    pdf = pdf.groupby(["g", "k"], as_index=False)["x"].sum()
    df = spark.createDataFrame(pdf)
    for desc in (False, True):
        got = running_totals(df, "k", ["x"], ["g"], bucket_rows=7, descending=desc).toPandas()
        want = pdf.sort_values(["g", "k"], ascending=[True, not desc])
        want["cum_x"] = want.groupby("g")["x"].cumsum()
        m = got.merge(want, on=["g", "k"], suffixes=("", "_w"))
        assert len(m) == len(pdf) and (m["cum_x"] == m["cum_x_w"]).all()


def test_stratified_with_null_stratum_and_deep_refinement(spark):
    from tabwright.functions.columns import md5_order
    from tabwright.functions.ranks import select_first
    df = spark.range(20000).withColumn("y", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3).cast("string")))
    quotas = {(None,): 77, ("0",): 1234, ("1",): 0, ("2",): 10**9}
    s = select_first(df, md5_order(["id"], 5), [], quotas, ["y"], window_limit=50)
    got = {r.y: r["count"] for r in s.groupBy("y").count().collect()}
    sizes = {r.y: r["count"] for r in df.groupBy("y").count().collect()}
    assert got.get(None) == 77 and got.get("0") == 1234 and "1" not in got and got.get("2") == sizes["2"]
    # the chosen rows are exactly the first ones in md5 order within each stratum
    pdf = df.withColumn("h", md5_order(["id"], 5)).toPandas()
    first0 = set(pdf[pdf.y == "0"].sort_values("h").id[:1234])
    assert set(r.id for r in s.where("y = '0'").collect()) == first0


def test_many_classes(spark, monkeypatch):
    """More classes than the driver's dictionary holds: the same rows as by the dictionary."""
    from pyspark.sql import functions as F
    from tabwright.operators import sample as S
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 53 == 0, None).otherwise(F.col("id") % 53 % 40).alias("y"))
    few = [sorted(map(tuple, f(df).collect())) for f in (
        lambda d: S.train_test_split(d, ["id"], 0.7, "y"), lambda d: S.undersample(d, "y", ["id"]))]
    monkeypatch.setattr(S, "FEW_CLASSES", 10)
    for limit in (100_000, 60):  # 60: some classes are cut by hash prefixes
        monkeypatch.setattr(S, "WINDOW_ROWS", limit)
        many = [sorted(map(tuple, f(df).collect())) for f in (
            lambda d: S.train_test_split(d, ["id"], 0.7, "y"), lambda d: S.undersample(d, "y", ["id"]))]
        assert many == few
    monkeypatch.setattr(S, "FEW_CLASSES", 10_000)
    monkeypatch.setattr(S, "WINDOW_ROWS", 100_000)
    wide = spark.range(150_000).select("id", (F.col("id") % 50_000).alias("y"))
    flags = S.train_test_split(wide, ["id"], 0.5, "y").groupBy("is_train").count().collect()
    assert {r[0]: r[1] for r in flags} == {True: 75_000, False: 75_000}


def test_auc_of_thousands_of_classes(spark):
    from pyspark.sql import functions as F
    from tabwright.operators.metrics import auc
    n = 5000
    scores = spark.range(n * 6).select((F.col("id") % n).cast("string").alias("cls"), (F.col("id") / n).cast("int").alias("j"))
    scores = scores.select("cls", (F.col("j") + 0.0).alias("score"), (F.col("j") >= 3).alias("is_pos"))
    scores = scores.union(spark.createDataFrame([(None, 1.0, True), (None, 1.0, False)], scores.schema))
    got = auc(scores, group=["cls"])
    assert got.count() == n + 1
    assert {r["auc"] for r in got.where("cls is not null").select("auc").distinct().collect()} == {1.0}
    assert got.where("cls is null").first()["auc"] == 0.5


def test_robust_fits_do_not_mind_the_order(spark):
    from pyspark.sql import functions as F
    from tabwright.models.catalog import get_model
    df = spark.range(400).select((F.col("id") * 1.0).alias("x"), (F.col("id") * 2.0 + F.col("id") % 7
                                                                + F.when(F.col("id") % 11 == 0, 500).otherwise(0)).alias("y"))
    for m in ("ransac", "tr"):
        fits = [get_model("regression", m).fit(d, ["x"], "y") for d in (
            df.repartition(3), df.repartition(11, "y"), df.orderBy(F.desc("x")).coalesce(1))]
        assert all(list(f.coef) == list(fits[0].coef) and f.intercept == fits[0].intercept for f in fits), m
