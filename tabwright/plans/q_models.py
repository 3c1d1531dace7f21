"""Registered model queries (C1-C3, V12-V13, X1-X4, H3-H9, clustering, NLP).

Model fits are randomised or iterative, so these carry no SQL oracle (rows and
schema checks only); the exact pieces they rely on (metrics, splits, folds,
Gram solvers) have their own oracle-checked queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.config import PrepConfig, RunConfig
from tabwright.models import cluster as C
from tabwright.models import text as TX
from tabwright.operators import prep as P
from tabwright.plans.experiment import Experiment
from tabwright.plans.registry import register, rounded
from tabwright.plans.search import hints, tune
from tabwright.plans.sqlgen import rnd
from tabwright.sources.tables import LINEITEM_KEY, sql_lineitem_with_nulls, table

_LI_COLS = [*LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _cls_exp(spark, sf, **prep):
    li = table(spark, sf, "lineitem").select(*_LI_COLS)
    return Experiment(li, "l_returnflag", LINEITEM_KEY, RunConfig("classification", folds=3),
                      PrepConfig(normalization="zscore", **prep)).setup()


def _reg_exp(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINEITEM_KEY, "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                             "l_linestatus")
    return Experiment(li, "l_extendedprice", LINEITEM_KEY, RunConfig("regression", folds=3)).setup()


@register("compare_classification_lineitem")
def q_compare_cls(spark, sf):
    return _cls_exp(spark, sf).compare_models(include=["lr", "nb", "dt", "lda", "qda", "ridge"], sort="accuracy").drop("fit_seconds")


@register("compare_regression_lineitem")
def q_compare_reg(spark, sf):
    return _reg_exp(spark, sf).compare_models(
        include=["lr", "ridge", "lasso", "en", "lar", "llar", "omp", "br", "ard", "huber", "dt"], sort="mae").drop("fit_seconds")


# ordinary least squares through the Gram aggregate equals the normal-equation fit in SQL
@register("ols_coefficients_lineitem", f"""
WITH m AS (SELECT avg(l_quantity) AS mq, avg(l_extendedprice) AS mp FROM lineitem)
SELECT 'l_quantity' AS feature, {rnd('regr_slope(l_extendedprice, l_quantity)', 4)} AS coef,
  {rnd('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept FROM lineitem""")
def q_ols(spark, sf):
    from tabwright.models.linear import GramRegressor
    li = table(spark, sf, "lineitem")
    f = GramRegressor("lr", "regression", "").fit(li, ["l_quantity"], "l_extendedprice")
    return rounded(spark.createDataFrame([("l_quantity", float(f.coef[0]), float(f.intercept))],
                                         "feature string, coef double, intercept double"), 4)


@register("importance_rf_lineitem")
def q_importance(spark, sf):
    ex = _reg_exp(spark, sf)
    return ex.importance(ex.create_model("rf", numTrees=20))


@register("evaluate_holdout_lineitem")
def q_evaluate(spark, sf):
    ex = _reg_exp(spark, sf)
    return ex.evaluate(ex.create_model("lr"))


@register("analyze_confusion_lineitem")
def q_analyze(spark, sf):
    ex = _cls_exp(spark, sf)
    return ex.analyze("lda")["confusion"]


@register("tune_random_dt_lineitem")
def q_tune(spark, sf):
    ex = _cls_exp(spark, sf)
    return tune(ex, "dt", "random", n_iter=4).trials


@register("tune_tpe_ridge_lineitem")
def q_tune_tpe(spark, sf):
    ex = _reg_exp(spark, sf)
    return tune(ex, "ridge", "tpe", n_iter=6).trials


@register("tuning_hints_lineitem")
def q_hints(spark, sf):
    ex = _cls_exp(spark, sf)
    board = ex.compare_models(include=["lr", "rf"], sort="accuracy", params={"rf": {"numTrees": 20}})
    return hints(board, "accuracy", target=0.9)


def _cust(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return P.scale(c, "zscore", exclude=["c_custkey"])


for _cid in ("kmeans", "hclust", "sc", "dbscan", "meanshift", "ap"):
    def _q(spark, sf, _cid=_cid):
        return C.CLUSTERERS[_cid](_cust(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey")
    register(f"cluster_{_cid}_customer")(_q)


for _tid in ("lda", "lsi", "nmf", "rp"):
    def _t(spark, sf, _tid=_tid):
        d = table(spark, sf, "documents").select("doc_id", "text")
        return TX.TOPIC_MODELS[_tid](d, "text", "doc_id")
    register(f"topics_{_tid}_documents")(_t)



# ---------------------------------------------------------------- explanation and model-based imputation

@register("contrib_ols_lineitem", f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {rnd('l_extendedprice', 2)} AS l_extendedprice,
  'l_quantity' AS feature, {rnd('b * (l_quantity - m)', 4)} AS contribution FROM lineitem, f""")
def q_contrib(spark, sf):
    from tabwright.models.linear import GramRegressor
    from tabwright.operators.explain import linear_contributions
    li = table(spark, sf, "lineitem").withColumn("__rid", F.struct(*LINEITEM_KEY, "l_extendedprice"))
    f = GramRegressor("lr", "regression", "").fit(li, ["l_quantity"], "l_extendedprice")
    c = linear_contributions(li, ["l_quantity"], f.coef, "__rid")
    return c.select(*[F.col(f"__rid.{k}").alias(k) for k in LINEITEM_KEY],
                    F.round("__rid.l_extendedprice", 2).alias("l_extendedprice"), "feature",
                    F.round("contribution", 4).alias("contribution"))


@register("shap_lr_customer")
def q_shap(spark, sf):
    from tabwright.models.linear import GramRegressor
    from tabwright.operators.explain import shapley_sampled
    c = table(spark, sf, "customer")
    f = GramRegressor("lr", "regression", "").fit(c, ["c_nationkey", "c_custkey"], "c_acctbal")
    return shapley_sampled(f, c, ["c_nationkey", "c_custkey"], "c_custkey", n_perm=5)


def _li_nulls_id(spark, sf):
    from tabwright.sources.tables import lineitem_with_nulls
    li = lineitem_with_nulls(spark, sf)
    return li.withColumn("rid", F.md5(F.concat_ws("|", *LINEITEM_KEY, "l_extendedprice"))).select(
        "rid", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _knn_fill_sql(cols: list[str], key: list[str], k: int) -> str:
    """Every row with a gap against all rows, by the distance on the columns both have."""
    both = [f"(g.{c} IS NOT NULL AND o.{c} IS NOT NULL)" for c in cols]
    total = " + ".join(f"CASE WHEN {b} THEN (g.{c} - o.{c}) * (g.{c} - o.{c}) ELSE 0 END" for b, c in zip(both, cols))
    shared = " + ".join(f"CAST({b} AS INT)" for b in both)
    near = [f"min({{'d': dist, 'v': o_{c}}}, {k}) FILTER (g_{c} IS NULL AND o_{c} IS NOT NULL) AS n_{c}" for c in cols]
    fill = [f"round(coalesce(t.{c}, list_avg(list_transform(n_{c}, lambda x: x.v)), (SELECT avg({c}) FROM t)), 4) AS {c}"
            for c in cols]
    gap = " OR ".join(f"{c} IS NULL" for c in cols)
    return f"""
WITH t AS ({sql_lineitem_with_nulls()}),
g AS (SELECT DISTINCT {", ".join(cols)} FROM t WHERE {gap}),
p AS (SELECT {", ".join(f"g.{c} AS g_{c}, o.{c} AS o_{c}" for c in cols)},
             ({total}) * {float(len(cols))}::DOUBLE / ({shared}) AS dist
      FROM g JOIN t AS o ON ({shared}) > 0),
f AS (SELECT {", ".join(f"g_{c}" for c in cols)}, {", ".join(near)} FROM p GROUP BY {", ".join(f"g_{c}" for c in cols)})
SELECT {", ".join(f"t.{c}" for c in key)}, {", ".join(fill)}
FROM t LEFT JOIN f ON {" AND ".join(f"t.{c} IS NOT DISTINCT FROM f.g_{c}" for c in cols)}
"""


_KNN_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("impute_knn_lineitem", _knn_fill_sql(_KNN_COLS, LINEITEM_KEY, 5))
def q_impute_knn(spark, sf):
    from tabwright.operators.impute_model import knn_impute
    from tabwright.sources.tables import lineitem_with_nulls
    li = lineitem_with_nulls(spark, sf).select(*LINEITEM_KEY, *_KNN_COLS)
    return rounded(knn_impute(li, _KNN_COLS), 4)


@register("impute_iterative_lineitem")
def q_impute_iter(spark, sf):
    from tabwright.operators.impute_model import iterative_impute
    return iterative_impute(_li_nulls_id(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                            rounds=5)


@register("compare_clustering_customer")
def q_compare_clu(spark, sf):
    from tabwright.plans.experiment import compare_unsupervised
    return compare_unsupervised(_cust(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey", "clustering",
                                include=["kmeans", "hclust", "dbscan"])


@register("compare_anomaly_customer")
def q_compare_ano(spark, sf):
    from tabwright.plans.experiment import compare_unsupervised
    return compare_unsupervised(_cust(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey", "anomaly",
                                include=["iforest", "histogram", "pca", "lof"])


@register("leaderboard_summary_lineitem")
def q_board_summary(spark, sf):
    from tabwright.operators.metrics import leaderboard_summary
    board = _reg_exp(spark, sf).compare_models(include=["lr", "ridge", "lasso", "omp", "br", "ard"], sort="mae")
    return leaderboard_summary(board, "mae", 5)


@register("data_summary_orders")
def q_data_summary(spark, sf):
    from tabwright.operators.profile import data_summary
    return data_summary(table(spark, sf, "orders"))


@register("analysis_summary_lineitem")
def q_analysis_summary(spark, sf):
    from tabwright.operators.explain import analysis_summary
    ex = _reg_exp(spark, sf)
    f = ex.create_model("lr")
    return analysis_summary(ex.importance(f), ex.predict(f), "__label", "prediction")


@register("dbscan_core_customer", """
WITH z AS (SELECT c_custkey,
  (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS a,
  (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS b
  FROM customer)
SELECT x.c_custkey, count(*) AS neighbours, count(*) >= 5 AS is_core
FROM z x JOIN z y ON sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2) <= 0.5 GROUP BY x.c_custkey""")
def q_dbscan_core(spark, sf):
    return C.core_flags(_cust(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey", 0.5, 5)


@register("dbscan_labels_customer", """
WITH RECURSIVE z AS (SELECT c_custkey AS id,
  (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS a,
  (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS b
  FROM customer),
e AS (SELECT x.id AS p, y.id AS q FROM z x JOIN z y ON sqrt((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2) <= 0.12),
core AS (SELECT p AS id FROM e GROUP BY p HAVING count(*) >= 4),
ce AS (SELECT p, q FROM e WHERE p IN (SELECT id FROM core) AND q IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.q, r.root FROM reach r JOIN ce ON ce.p = r.id),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM lab)),
own AS (SELECT lab.id, num.cluster FROM lab JOIN num USING (root)),
edge AS (SELECT e.p AS id, min(own.cluster) AS cluster FROM e JOIN own ON own.id = e.q
  WHERE e.p NOT IN (SELECT id FROM core) GROUP BY e.p)
SELECT z.id AS c_custkey, CAST(coalesce(own.cluster, edge.cluster, -1) AS INTEGER) AS cluster
FROM z LEFT JOIN own ON own.id = z.id LEFT JOIN edge ON edge.id = z.id""")
def q_dbscan_labels(spark, sf):
    return C.dbscan(_cust(spark, sf), ["c_acctbal", "c_nationkey"], "c_custkey", 0.12, 4)


_NB_X = ["l_quantity", "l_discount", "l_tax"]


@register("nb_predict_lineitem", """
WITH s AS (SELECT l_returnflag AS cls, count(*) AS n,
    avg(l_quantity) AS m1, var_pop(l_quantity) AS v1, avg(l_discount) AS m2, var_pop(l_discount) AS v2,
    avg(l_tax) AS m3, var_pop(l_tax) AS v3 FROM lineitem GROUP BY 1),
e AS (SELECT 1e-9 * greatest(var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax)) AS eps,
    count(*) AS total FROM lineitem),
sc AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, s.cls,
    ln(s.n / e.total) - 0.5 * (ln(2 * pi() * (s.v1 + e.eps)) + ln(2 * pi() * (s.v2 + e.eps)) + ln(2 * pi() * (s.v3 + e.eps)))
    - 0.5 * ((l.l_quantity - s.m1) ^ 2 / (s.v1 + e.eps) + (l.l_discount - s.m2) ^ 2 / (s.v2 + e.eps)
             + (l.l_tax - s.m3) ^ 2 / (s.v3 + e.eps)) AS score
  FROM lineitem l, s, e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS l_extendedprice,
  arg_max(cls, score) AS prediction FROM sc GROUP BY ALL""")
def q_nb(spark, sf):
    from tabwright.models.linear import GaussianNB
    li = table(spark, sf, "lineitem")
    f = GaussianNB("nb", "classification", "").fit(li, _NB_X, "l_returnflag")
    names = F.array(*[F.lit(c) for c in f.classes])
    out = f.transform(li)
    return out.select(*LINEITEM_KEY, F.round("l_extendedprice", 2).alias("l_extendedprice"),
                      F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"))


@register("lda_predict_lineitem", """
WITH s AS (SELECT l_returnflag AS cls, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2,
    var_pop(l_quantity) * count(*) AS w11, var_pop(l_discount) * count(*) AS w22,
    covar_pop(l_quantity, l_discount) * count(*) AS w12 FROM lineitem GROUP BY 1),
p AS (SELECT sum(w11) / (sum(n) - count(*)) AS s11, sum(w22) / (sum(n) - count(*)) AS s22,
    sum(w12) / (sum(n) - count(*)) AS s12, sum(n) AS total FROM s),
i AS (SELECT s22 / (s11 * s22 - s12 * s12) AS a11, s11 / (s11 * s22 - s12 * s12) AS a22,
    -s12 / (s11 * s22 - s12 * s12) AS a12, total FROM p),
c AS (SELECT cls, a11 * m1 + a12 * m2 AS w1, a12 * m1 + a22 * m2 AS w2,
    -0.5 * (m1 * (a11 * m1 + a12 * m2) + m2 * (a12 * m1 + a22 * m2)) + ln(n / total) AS c0 FROM s, i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS l_extendedprice,
  arg_max(cls, l_quantity * w1 + l_discount * w2 + c0) AS prediction FROM lineitem, c GROUP BY ALL""")
def q_lda(spark, sf):
    from tabwright.models.linear import Discriminant
    li = table(spark, sf, "lineitem")
    f = Discriminant("lda", "classification", "").fit(li, ["l_quantity", "l_discount"], "l_returnflag")
    names = F.array(*[F.lit(c) for c in f.classes])
    return f.transform(li).select(*LINEITEM_KEY, F.round("l_extendedprice", 2).alias("l_extendedprice"),
                                  F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"))


@register("rfe_lineitem")
def q_rfe(spark, sf):
    """Two of four features kept by recursive elimination, as (feature, kept)."""
    from tabwright.operators.select_model import rfe
    li = table(spark, sf, "lineitem")
    x = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    kept = rfe(li, x, "l_extendedprice", 2, classification=False)
    return spark.createDataFrame([(c, c in kept) for c in x], "feature string, kept boolean")


@register("et_predict_lineitem")
def q_extra_trees(spark, sf):
    """Extremely randomised trees on all rows: predicted price beside the price."""
    from tabwright.models.catalog import get_model
    li = table(spark, sf, "lineitem")
    f = get_model("regression", "et").with_params(numTrees=20).fit(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(f.transform(li).select(*LINEITEM_KEY, "l_extendedprice", "prediction"))
