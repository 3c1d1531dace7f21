import numpy as np

from tabwright.operators import anomaly


def _rows(spark):
    x = np.random.default_rng(9).normal(size=(600, 2))
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(600, 9.0, 9.0)],
                                 "id long, a double, b double").coalesce(1)


def test_iforest_scores_are_stored_and_spread(spark, monkeypatch):
    """The cut of the scores reads them several times, which must not walk the trees again."""
    df = _rows(spark)
    whole = anomaly.iforest(df, ["a", "b"], n_trees=10)
    assert "EvalPython" not in whole._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(anomaly, "TASK_ROWS", 100)
    dealt = anomaly.iforest(df, ["a", "b"], n_trees=10)
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() > 1
    one, two = ({r["id"]: r["score"] for r in s.collect()} for s in (whole, dealt))
    assert one == two and max(one, key=one.get) == 600


def test_ocsvm_rows_are_spread(spark, monkeypatch):
    df = _rows(spark)
    one = {r["id"]: r["score"] for r in anomaly.ocsvm(df, ["a", "b"], steps=3).collect()}
    monkeypatch.setattr(anomaly, "TASK_ROWS", 100)
    dealt = anomaly.ocsvm(df, ["a", "b"], steps=3)
    assert dealt.rdd.getNumPartitions() > 1
    two = {r["id"]: r["score"] for r in dealt.collect()}
    assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
