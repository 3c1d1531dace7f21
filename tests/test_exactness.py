"""Values a double can't hold, equal keys, null rows and text ids."""

import pytest
from pyspark.sql import functions as F

from tabwright.config import PrepConfig, RunConfig
from tabwright.functions.columns import md5_order
from tabwright.functions.ranks import select_first
from tabwright.models.cluster import kmeans
from tabwright.models.text import TOPIC_MODELS, _uniform, lda_topics, term_counts
from tabwright.operators import anomaly, prep, profile, types
from tabwright.operators.impute_model import fit_iterative, knn_impute
from tabwright.operators.neighbors import smote
from tabwright.plans.experiment import Experiment

BIG = 2**53


def test_profile_and_mode_of_big_integers(spark):
    rows = [(BIG + i,) for i in range(8)] + [(BIG + 1,)]
    df = spark.createDataFrame(rows, "a long")
    r = profile.profile(df).first()
    assert r.n_unique == 8
    gap = spark.createDataFrame([*rows, (None,)], "a long")
    assert prep.fit_imputer(gap, "mode").transform(gap).where(F.col("a") == BIG + 1).count() == 3


def test_text_of_big_integers(spark):
    df = spark.createDataFrame([(str(BIG + 1), "1.0"), ("7", "1e3")], "a string, b string")
    got = types.apply_types(df, {"a": "bigint", "b": "bigint"}).collect()
    assert [tuple(r) for r in got] == [(BIG + 1, 1), (7, 1000)]


def test_equal_keys_end_and_ties_decide(spark):
    df = spark.range(60).withColumn("h", F.md5(F.lit("same")))
    got = select_first(df, F.col("h"), ["id"], {(): 17}, [], window_limit=4)
    assert sorted(r.id for r in got.collect()) == list(range(17))
    by = df.withColumn("g", F.col("id") % 2).withColumn("h", F.when(F.col("id") < 40, F.col("h")).otherwise(F.md5(F.col("id").cast("string"))))
    n = {r.g: r["count"] for r in select_first(by, F.col("h"), ["id"], {(0,): 9, (1,): 25}, ["g"], window_limit=4)
         .groupBy("g").count().collect()}
    assert n == {0: 9, 1: 25}
    same = spark.createDataFrame([("k", 1)] * 20, "h string, t int")
    assert select_first(same, F.col("h"), ["t"], {(): 5}, [], window_limit=4).count() == 20  # equal in every key
    assert select_first(df, md5_order(["id"], 1), [], {(): 33}, [], window_limit=4).count() == 33


def test_text_ids_in_smote(spark):
    rows = [(f"id{i}", float(i % 5), float(i % 3), "a" if i < 8 else "b") for i in range(12)]
    df = spark.createDataFrame(rows, "id string, x double, y double, c string")
    n = {r.c: r["count"] for r in smote(df, "c", ["x", "y"], "id", k=2).groupBy("c").count().collect()}
    assert n == {"a": 8, "b": 8}


def test_rows_with_nulls_stay(spark):
    rows = [(i, float(i % 4), float(i // 4)) for i in range(19)] + [(19, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.id: r.cluster for r in kmeans(df, ["x", "y"], "id", k=2).collect()}
    assert len(got) == 20 and got[19] is None and None not in [got[i] for i in range(19)]
    scores = {r.id: r.score for r in anomaly.cluster_score(df, ["x", "y"], "id", k=2).collect()}
    assert len(scores) == 20 and scores[19] is None
    assert 19 in [r.id for r in anomaly.remove_outliers(df, ["x", "y"], "id", 0.1, "pca").collect()]
    h = {r.id: r.score for r in anomaly.hbos(df, ["x", "y"], id_col="id").collect()}
    assert h[19] == max(h.values())


@pytest.mark.parametrize("method", ["knn", "iterative"])
def test_experiment_fills_gaps_from_training_rows(spark, method):
    rows = [(i, 1000.0 + i if i % 7 else None, 2.0 * i, float(3 * i % 11)) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    ex = Experiment(df, "y", ["id"], RunConfig("regression", folds=2), PrepConfig(imputation=method)).setup()
    for part in (ex.design, ex.transform(ex.holdout)):
        lo = part.agg(F.min("a"), F.count(F.when(F.col("a").isNull(), 1))).first()
        assert lo[0] > 990 and lo[1] == 0
    assert ex.transform(ex.holdout).count() == ex.holdout.count()


def test_iterative_keeps_observed_values_and_reports(spark):
    rows = [(i, float(i) if i % 6 else None, 2.0 * i + 1, float(i % 4) if i % 9 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    fitted = fit_iterative(df, ["a", "b", "c"], rounds=20)
    out = {r.id: r for r in fitted.transform(df).collect()}
    assert fitted.converged and len(out) == 80
    for i, a, b, c in rows:
        assert out[i].a == pytest.approx(a if a is not None else i, abs=0.5) and out[i].b == b
        assert c is None or out[i].c == c
        assert out[i].c is not None


def test_knn_impute_is_the_mean_of_the_nearest(spark):
    rows = [(i, float(i * i % 23), float(i * 7 % 13), float(i)) for i in range(40)]
    rows += [(100 + i, float(i * 5 % 23), None, float(i * 2)) for i in range(6)] + [(200, None, None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: r for r in knn_impute(df, ["a", "b", "c"], "id", k=3).collect()}
    full = [r for r in rows if None not in r]
    for i, a, b, c in rows:
        if b is None and a is not None:
            near = sorted(full, key=lambda r: ((r[1] - a) ** 2 + (r[3] - c) ** 2, r[0]))
            dist = [(r[1] - a) ** 2 + (r[3] - c) ** 2 for r in near]
            if dist[2] != dist[3]:
                assert got[i].b == pytest.approx(sum(r[2] for r in near[:3]) / 3)
    assert len(got) == len(rows) and all(None not in tuple(r) for r in got.values())


def test_topics_keep_every_word_of_any_script(spark):
    df = spark.createDataFrame([(1, "größe café текст größe"), (2, "café once"), (3, None), (4, "")], "id long, t string")
    got = {(r.doc, r.term): r.n for r in term_counts(df, "t", "id").collect()}
    assert got == {(1, "größe"): 2, (1, "café"): 1, (1, "текст"): 1, (2, "café"): 1}
    for name, fn in TOPIC_MODELS.items():
        w = fn(df, "t", "id", k=2)
        assert w.count() == 8 and {r.id for r in w.collect()} == {1, 2, 3, 4}, name


def test_nmf_and_lsi_match_dense_algebra(spark):
    import numpy as np

    from tabwright.models.text import lsi_topics, nmf_topics, tfidf
    vocab = "apple pear plum grape quartz basalt granite marble".split()
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(rng.choice(vocab[:4] if i % 2 else vocab[4:], 30)) + " " + str(rng.choice(vocab))) for i in range(24)]
    df = spark.createDataFrame(docs, "id long, t string")
    counts = term_counts(df, "t", "id")
    m = np.zeros((24, 8))
    for r in tfidf(counts, 24).collect():
        m[r.doc, vocab.index(r.term)] = r.w
    want = np.linalg.svd(m, compute_uv=False)[:2]
    got = np.zeros((24, 2))
    for r in lsi_topics(df, "t", "id", k=2).collect():
        got[r.id, r.topic] = r.weight
    assert np.linalg.norm(got, axis=0) == pytest.approx(want, rel=1e-3)
    w = np.zeros((24, 2))
    for r in nmf_topics(df, "t", "id", k=2, max_iter=30).collect():
        w[r.id, r.topic] = r.weight
    main = w.argmax(1)
    assert len(set(main[::2])) == len(set(main[1::2])) == 1 and main[0] != main[1] and (w >= 0).all()


def test_topics_send_a_term_once_a_block(spark, monkeypatch):
    from tabwright.models import text
    rows = [(i, " ".join(f"word{(i * j) % 11}" for j in range(1, 30))) for i in range(1, 41)]
    rows += [(1, "other word1"), (None, "word1 nowhere"), (None, "word2"), (50, None)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(1)
    few = {"lda": {"max_iter": 1}, "lsi": {"rounds": 1}, "nmf": {"max_iter": 1}, "rp": {}}

    def weights(name):
        found = TOPIC_MODELS[name](df, "t", "id", k=2, **few[name]).where("id is not null")
        return {(r.id, r.topic): r.weight for r in found.distinct().collect()}
    whole = {name: weights(name) for name in few}
    assert text.Counts(df, "t", "id").uses.where("key >= 0").count() < 40  # 13 terms in two blocks, 420 counts and more
    monkeypatch.setattr(text, "BLOCK_WORDS", 100)  # many blocks on few rows
    counts = text.Counts(df, "t", "id")
    assert counts.rows.select("b").distinct().count() > 5
    names = counts.uses.join(counts.terms, "key").select("b", "at", "term")
    got = counts.rows.selectExpr("b", "doc", "explode(arrays_zip(cols, ns)) e").selectExpr(
        "b", "doc", "e.cols at", "e.ns n").join(names, ["b", "at"])
    assert ({(r.doc, r.term, r.n) for r in got.collect()}
            == {(r.doc, r.term, r.n) for r in term_counts(df, "t", "id").collect()})
    for name in few:
        assert weights(name) == pytest.approx(whole[name], rel=1e-5, abs=1e-8), name


def _plain_knn_fills(rows, k):
    """Brute force of ``knn_impute``: every row against every other, on the columns both have."""
    d = len(rows[0])
    out = []
    for r in rows:
        new = list(r)
        for t in range(d):
            if r[t] is None:
                near = []
                for o in rows:
                    both = [j for j in range(d) if r[j] is not None and o[j] is not None]
                    if o[t] is not None and both:
                        near.append((sum((r[j] - o[j]) ** 2 for j in both) * d / len(both), o[t]))
                vals = [v for _, v in sorted(near)[:k]]
                known = [o[t] for o in rows if o[t] is not None]
                new[t] = sum(vals) / len(vals) if vals else sum(known) / len(known) if known else None
        out.append(tuple(new))
    return out


@pytest.mark.parametrize("kind", ["scattered", "hot", "disjoint"])
def test_knn_impute_uses_donors_with_gaps(spark, kind, monkeypatch):
    import random

    from tabwright.operators import masked_knn
    monkeypatch.setattr(masked_knn, "STRIP_ROWS", 8)  # many blocks on few rows
    monkeypatch.setattr(masked_knn, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    if kind == "disjoint":  # donors share no column with the row, a column without values, a row without values
        rows = [(1.0, None, None), (2.0, None, None), (None, 5.0, None), (None, 7.0, None), (None, None, None)]
    else:
        wide = [100.0, 3.0, 1.0, 20.0]
        rows = [tuple(None if rng.random() < 0.3 else round(rng.random() * w, 2 if kind == "scattered" else -1)
                      for w in wide) for _ in range(240)]
        rows += [rows[0]] * 60 if kind == "hot" else []
    names = [f"f{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)],
                               "id long, " + ", ".join(f"{c} double" for c in names) + ", vec string")
    got = {r.id: tuple(r[c] for c in names) for r in knn_impute(df, names, k=5).collect()}
    want = _plain_knn_fills(rows, 5)
    assert len(got) == len(rows)
    for i, w in enumerate(want):
        assert got[i] == pytest.approx(w), (i, rows[i])
    assert knn_impute(df.limit(0), names).collect() == []


def test_lda_matches_dense_expectation_maximisation(spark):
    import numpy as np
    from pyspark.sql import functions as F
    rows = [(i, " ".join(f"{'ab'[i % 2]}word{(i * j) % 7}" for j in range(1, 6 + i % 3))) for i in range(12)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    doc, terms = lda_topics(df, "t", "id", k=2, max_iter=6, doc_prior=1.5)
    counts = term_counts(df, "t", "id").withColumn("key", F.concat_ws("|", F.col("doc").cast("string"), "term"))
    got = counts.select("doc", "term", "n", *[_uniform(F.col("key"), j, 42).alias(f"u{j}") for j in range(2)]).collect()
    docs, vocab = sorted({r.doc for r in got}), sorted({r.term for r in got})
    a = np.zeros((2, len(docs), len(vocab)))
    n = np.zeros((len(docs), len(vocab)))
    for r in got:
        n[docs.index(r.doc), vocab.index(r.term)] = r.n
        a[:, docs.index(r.doc), vocab.index(r.term)] = r.u0, r.u1
    for step in range(7):
        phi = n * a / np.where(n > 0, a.sum(0), 1)
        d, t = phi.sum(2), phi.sum(1)
        a = (d[:, :, None] + 0.5) * (t[:, None, :] + 0.1) / (t.sum(1) + len(vocab) * 0.1)[:, None, None]
    share = (d + 0.5) / (d + 0.5).sum(0)
    weights = {(r.id, r.topic): r.weight for r in doc.collect()}
    for i, x in enumerate(docs):
        assert [weights[x, j] for j in range(2)] == pytest.approx(share[:, i].tolist(), rel=1e-6)
    assert weights[99, 0] == weights[99, 1] == 0.5 and len(weights) == 26
    for j in range(2):
        want = sorted(((-t[j, i], w) for i, w in enumerate(vocab)))[:10]
        assert [r.term for r in terms.where(F.col("topic") == j).orderBy("rank").collect()] == [w for _, w in want]
