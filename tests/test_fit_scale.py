import numpy as np
from pyspark.sql import functions as F


def test_design_rows_are_dealt_to_tasks(spark, monkeypatch):
    from tabwright.config import RunConfig
    from tabwright.plans import experiment as E
    monkeypatch.setattr(E, "FIT_ROWS", 50, raising=False)
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"),
                                 (F.col("id") % 3).cast("string").alias("y")).coalesce(1)
    ex = E.Experiment(df, "y", ["id"], RunConfig("classification", folds=2)).setup()
    held = ex.design.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) > 4 and max(r["count"] for r in held) < 100
    assert ex.design.select("id").distinct().count() == ex.design.count()


def test_auc_reads_its_scores_once(spark):
    from tabwright.operators import metrics as M
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return float(i * 37 % 101)
    df = spark.range(300).select(F.col("id"), (F.col("id") % 2 == 0).alias("is_pos")).repartition(3).withColumn(
        "score", score("id"))
    got = M.auc(df).first()
    i = np.arange(300)
    s, pos = i * 37 % 101, i % 2 == 0
    want = np.mean((s[pos][:, None] > s[~pos]) + 0.5 * (s[pos][:, None] == s[~pos]))
    assert abs(got["auc"] - want) < 1e-12
    assert seen.value == 300


def test_discriminant_probabilities(spark):
    from tabwright.models.linear import DiscriminantFitted
    f = DiscriminantFitted("lda", ["a", "b"], [0.0, 1.0, 2.0], [None, None, [[0.5, 0.1], [0.2, -0.3]]],
                           [[1.0, 2.0], [0.5, -1.0], [0.0, 0.25]], [0.1, 0.2, 0.3])
    x = np.array([[0.0, 0.0], [1.5, -2.0], [3.0, 0.5], [-4.0, 2.0]])
    out = f.transform(spark.createDataFrame(x.tolist(), "a double, b double"))
    assert out.columns == ["a", "b", "probability", "prediction", "score"]
    A = np.array(f.A[2])
    s = x @ np.array(f.w).T + np.array(f.c0)
    s[:, 2] += np.einsum("ni,ij,nj->n", x, A, x)
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    rows = sorted(out.collect(), key=lambda r: (r.a, r.b))
    order = np.lexsort((x[:, 1], x[:, 0]))
    np.testing.assert_allclose([r.probability for r in rows], p[order], atol=1e-12)
    assert [r.prediction for r in rows] == s.argmax(1)[order].astype(float).tolist()


def test_affinity_rounds_are_one_chain(spark, monkeypatch):
    """Labels as by plain loops over the edges; rounds aren't checkpointed one by one."""
    from collections import defaultdict
    from tabwright.models import cluster as C
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, 12) for c in (0.0, 4.0, 9.0)])
    rows = [(i, float(v)) for i, v in enumerate(x)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, x double")
    cuts, real = [], C.cut_lineage

    def counted(d):
        cuts.append(1)
        return real(d)
    monkeypatch.setattr(C, "cut_lineage", counted)
    got = {r["id"]: r["cluster"] for r in C.affinity_propagation(df, ["x"], "id", n_neighbors=5, rounds=20).collect()}
    assert len(cuts) <= 5
    s = {}
    for i, v in enumerate(x):
        for k in sorted(range(len(x)), key=lambda j: abs(x[j] - v))[1:6]:
            s[i, k] = -(x[k] - v) ** 2
    pref = sorted(s.values())
    pref = (pref[(len(pref) - 1) // 2] + pref[len(pref) // 2]) / 2
    s.update({(i, i): pref for i in range(len(x))})
    a, r = dict.fromkeys(s, 0.0), dict.fromkeys(s, 0.0)
    for _ in range(20):
        for i, k in s:
            best = max(a[e] + s[e] for e in s if e[0] == i and e[1] != k)
            r[i, k] = 0.5 * r[i, k] + 0.5 * (s[i, k] - best)
        pos = defaultdict(float)
        for i, k in s:
            if i != k:
                pos[k] += max(0.0, r[i, k])
        a = {(i, k): 0.5 * a[i, k] + 0.5 * (pos[k] if i == k else min(0.0, r[k, k] + pos[k] - max(0.0, r[i, k])))
             for i, k in s}
    ex = sorted(k for i, k in s if i == k and r[i, k] + a[i, k] > 0)
    want = {}
    for i in range(len(x)):
        near = [(s[i, k], k) for k in ex if (i, k) in s]
        want[i] = ex.index(max(near)[1]) if near else -1
    assert ex and got.pop(99) is None and got == want
