"""Registered kNN queries (K1, knn model, D3, D4, D5, D7, B2-B4).

The oracles are brute force in DuckDB (all pairs); the Spark side never forms
all pairs (see ``operators.knn``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import anomaly, neighbors
from tabwright.operators.knn import knn_join
from tabwright.plans.registry import register, rounded
from tabwright.plans.sqlgen import rnd
from tabwright.sources.tables import table

K = 5
NB_SQL = f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
nb AS (SELECT a.id AS qid, b.id AS nid, list_distance(a.v, b.v) AS dist,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM e a, e b WHERE a.id <> b.id QUALIFY rank <= {K})"""


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                                 F.col("embedding").cast("array<double>").alias("vec"), "label")


@register("knn_join_embeddings", f"{NB_SQL} SELECT qid, nid, CAST(rank AS INTEGER) AS rank, {rnd('dist')} AS dist FROM nb")
def q_knn_join(spark, sf):
    return rounded(knn_join(embeddings(spark, sf), k=K))


@register("knn_classify_embeddings", f"""{NB_SQL},
v AS (SELECT nb.qid, e.label, count(*) AS n FROM nb JOIN e ON e.id = nb.nid GROUP BY ALL)
SELECT qid AS id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) = 1""")
def q_knn_classify(spark, sf):
    e = embeddings(spark, sf)
    return neighbors.knn_predict(e, e, "label", K, exclude_self=True)


@register("knn_regress_embeddings", f"""{NB_SQL}
SELECT nb.qid AS id, {rnd('avg(e.label)')} AS prediction FROM nb JOIN e ON e.id = nb.nid GROUP BY nb.qid""")
def q_knn_regress(spark, sf):
    e = embeddings(spark, sf)
    return rounded(neighbors.knn_predict(e, e, "label", K, classification=False, exclude_self=True))


@register("knn_outlier_embeddings", f"{NB_SQL} SELECT qid AS id, {rnd('max(dist)')} AS score FROM nb GROUP BY qid")
def q_knn_outlier(spark, sf):
    return rounded(neighbors.knn_outlier(embeddings(spark, sf), K))


@register("lof_embeddings", f"""{NB_SQL},
kd AS (SELECT qid, max(dist) AS kdist FROM nb GROUP BY qid),
lrd AS (SELECT nb.qid, 1.0 / avg(greatest(nb.dist, kd.kdist)) AS lrd FROM nb JOIN kd ON kd.qid = nb.nid GROUP BY nb.qid)
SELECT nb.qid AS id, {rnd('avg(l2.lrd) / any_value(l1.lrd)')} AS score
FROM nb JOIN lrd l2 ON l2.qid = nb.nid JOIN lrd l1 ON l1.qid = nb.qid GROUP BY nb.qid""")
def q_lof(spark, sf):
    return rounded(neighbors.lof(embeddings(spark, sf), K))


@register("abod_embeddings", f"""{NB_SQL},
d AS (SELECT nb.qid, nb.rank, list_transform(list_zip(x.v, p.v), lambda t: t[1] - t[2]) AS u
      FROM nb JOIN e x ON x.id = nb.nid JOIN e p ON p.id = nb.qid)
SELECT a.qid AS id, {rnd('-var_pop(list_dot_product(a.u, b.u) / (list_dot_product(a.u, a.u) * list_dot_product(b.u, b.u)))', 4)} AS score
FROM d a JOIN d b ON a.qid = b.qid AND a.rank < b.rank GROUP BY a.qid""")
def q_abod(spark, sf):
    s = neighbors.abod(embeddings(spark, sf), K)
    return rounded(s.withColumn("score", F.col("score") * 1.0), 4)


_HB_COLS = ["c_acctbal", "c_nationkey"]


@register("hbos_customer", """
WITH b AS (SELECT c_custkey,
  least(floor((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / nullif((SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 0) * 10), 9) AS b1,
  least(floor((c_nationkey - (SELECT min(c_nationkey) FROM customer)) / nullif((SELECT max(c_nationkey) - min(c_nationkey) FROM customer), 0) * 10), 9) AS b2
  FROM customer),
h1 AS (SELECT b1, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS p FROM b GROUP BY b1),
h2 AS (SELECT b2, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS p FROM b GROUP BY b2)
SELECT c_custkey AS id, round(-ln(h1.p) - ln(h2.p), 6) AS score FROM b JOIN h1 USING (b1) JOIN h2 USING (b2)""")
def q_hbos(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    return rounded(anomaly.hbos(c, _HB_COLS, bins=10, id_col="id"))


_OVERSAMPLED = """
WITH c AS (SELECT CAST(c_acctbal > 9000 AS INTEGER) AS y, count(*) AS n FROM customer GROUP BY 1)
SELECT y, false AS synthetic, n FROM c
UNION ALL SELECT y, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)"""


def _oversampled(method):
    def q(spark, sf):
        c = table(spark, sf, "customer").withColumn("y", (F.col("c_acctbal") > 9000).cast("int"))
        s = neighbors.smote(c, "y", ["c_acctbal", "c_nationkey"], "c_custkey", method=method)
        return s.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))
    return q


for _m in ("smote", "adasyn", "borderline"):
    register(f"{_m}_counts_customer", _OVERSAMPLED)(_oversampled(_m))


_AN_X = ["c_acctbal", "c_nationkey"]


def _anomaly_q(method):
    def q(spark, sf):
        c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
        return anomaly.score_table(anomaly.DETECTORS[method](c, _AN_X, id_col="id"), 0.05)
    return q


for _m in ("iforest", "mcd", "cluster", "svm"):
    register(f"anomaly_{_m}_customer")(_anomaly_q(_m))


# standardised PCA over all components = squared Mahalanobis distance under the sample covariance
@register("anomaly_pca_customer", f"""
WITH m AS (SELECT avg(c_acctbal) AS mx, avg(c_nationkey) AS my, var_samp(c_acctbal) AS a,
  var_samp(c_nationkey) AS c, covar_samp(c_acctbal, c_nationkey) AS b FROM customer),
s AS (SELECT c_custkey AS id, (c * (c_acctbal - mx) ^ 2 - 2 * b * (c_acctbal - mx) * (c_nationkey - my)
  + a * (c_nationkey - my) ^ 2) / (a * c - b * b) AS score FROM customer, m)
SELECT id, {rnd('score')} AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS is_outlier FROM s""")
def q_anomaly_pca(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "id")
    return rounded(anomaly.score_table(anomaly.pca_score(c, _AN_X, id_col="id"), 0.05))


@register("cof_embeddings")
def q_cof(spark, sf):
    return neighbors.cof(embeddings(spark, sf), K)


# standardised PCA score as in anomaly_pca_customer; rows above its 95 % quantile go
@register("remove_outliers_pca_customer", """
WITH m AS (SELECT avg(c_acctbal) AS mx, avg(c_nationkey) AS my, var_samp(c_acctbal) AS a,
  var_samp(c_nationkey) AS c, covar_samp(c_acctbal, c_nationkey) AS b FROM customer),
s AS (SELECT c_custkey, (c * (c_acctbal - mx) ^ 2 - 2 * b * (c_acctbal - mx) * (c_nationkey - my)
  + a * (c_nationkey - my) ^ 2) / (a * c - b * b) AS score FROM customer, m)
SELECT customer.* FROM customer JOIN s USING (c_custkey) WHERE score <= (SELECT quantile_cont(score, 0.95) FROM s)""")
def q_remove_outliers_pca(spark, sf):
    return anomaly.remove_outliers(table(spark, sf, "customer"), _AN_X, "c_custkey", 0.05, "pca")


@register("remove_outliers_customer")
def q_remove_outliers(spark, sf):
    c = table(spark, sf, "customer")
    return anomaly.remove_outliers(c, _AN_X, "c_custkey", 0.05, "iforest")
