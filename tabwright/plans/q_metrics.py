"""Registered evaluation queries (V1-V11, V14) over prediction tables derived from the test tables.

Predictions come from simple fitted rules both engines can reproduce: a
length-based score for document quality, a turn-based guess of the speaker role,
and a one-feature least-squares line for the extended price.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators import metrics as M
from tabwright.plans.registry import register, rounded
from tabwright.plans.sqlgen import rnd
from tabwright.sources.tables import LINEITEM_KEY, table

BIN_SQL = ("SELECT l.doc_id, l.quality AS label, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS score, "
           "CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS prediction FROM labels l JOIN documents d USING (doc_id)")
MULTI_SQL = ("SELECT conv_id, turn, role AS label, CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 1 THEN 'assistant' "
             "ELSE 'user' END AS prediction FROM conversations")
OLS_SQL = ("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a "
           f"FROM lineitem) SELECT {', '.join(LINEITEM_KEY)}, l_extendedprice AS label, a + b * l_quantity AS prediction "
           "FROM lineitem, f")
UNIT_SQL = ("SELECT l_extendedprice AS label, l_quantity * (SELECT avg(l_extendedprice / l_quantity) FROM lineitem) "
            "AS prediction FROM lineitem")


def binary_predictions(spark, sf):
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", F.col("quality").alias("label"),
                    (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score"),
                    F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("prediction"))


def multi_predictions(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.col("role").alias("label"),
                    F.when(F.col("turn") == 0, "system").when(F.col("turn") % 2 == 1, "assistant")
                    .otherwise("user").alias("prediction"))


def ols_predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    r = li.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("b"),
               F.regr_intercept("l_extendedprice", "l_quantity").alias("a")).first()
    return li.select(*LINEITEM_KEY, F.col("l_extendedprice").alias("label"),
                     (F.lit(r["a"]) + F.lit(r["b"]) * F.col("l_quantity")).alias("prediction"))


def unit_price_predictions(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).first()[0]
    return li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.lit(m)).alias("prediction"))


def _cls_sql(src: str) -> str:
    return f"""
WITH p AS ({src}),
cm AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL),
pc AS (SELECT cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
  SELECT label AS cls, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cm
  UNION ALL SELECT prediction, 0, 0, n FROM cm) GROUP BY cls),
m AS (SELECT *, CASE WHEN predicted <> 0 THEN tp::DOUBLE / predicted ELSE 0 END AS pr,
                CASE WHEN support <> 0 THEN tp::DOUBLE / support ELSE 0 END AS rc FROM pc),
t AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS s, sum(support * pr) AS wp, sum(support * rc) AS wr,
  sum(support * CASE WHEN pr + rc <> 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) AS wf,
  sum(support::DOUBLE * predicted) AS pt, sum(predicted::DOUBLE * predicted) AS pp, sum(support::DOUBLE * support) AS tt FROM m)
SELECT {rnd('c / s')} AS accuracy, {rnd('wp / s')} AS precision, {rnd('wr / s')} AS recall, {rnd('wf / s')} AS f1,
  {rnd('CASE WHEN pt / (s * s) <> 1 THEN (c / s - pt / (s * s)) / (1 - pt / (s * s)) ELSE 0 END')} AS kappa,
  {rnd('CASE WHEN sqrt((s * s - pp) * (s * s - tt)) <> 0 THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END')} AS mcc
FROM t"""


def _report_sql(src: str) -> str:
    return f"""
WITH p AS ({src}),
cm AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL),
pc AS (SELECT cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
  SELECT label AS cls, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cm
  UNION ALL SELECT prediction, 0, 0, n FROM cm) GROUP BY cls),
m AS (SELECT *, CASE WHEN predicted <> 0 THEN tp::DOUBLE / predicted ELSE 0 END AS pr,
                CASE WHEN support <> 0 THEN tp::DOUBLE / support ELSE 0 END AS rc FROM pc)
SELECT CAST(cls AS VARCHAR) AS cls, {rnd('pr')} AS precision, {rnd('rc')} AS recall,
  {rnd('CASE WHEN pr + rc <> 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END')} AS f1, CAST(support AS BIGINT) AS support FROM m"""


@register("classification_metrics_binary", _cls_sql(BIN_SQL))
def q_cls_binary(spark, sf):
    return rounded(M.classification_metrics(binary_predictions(spark, sf)))


@register("classification_metrics_multiclass", _cls_sql(MULTI_SQL))
def q_cls_multi(spark, sf):
    return rounded(M.classification_metrics(multi_predictions(spark, sf)))


@register("class_report_multiclass", _report_sql(MULTI_SQL))
def q_report_multi(spark, sf):
    return rounded(M.class_report(multi_predictions(spark, sf)))


@register("confusion_multiclass", f"SELECT label, prediction, count(*) AS n FROM ({MULTI_SQL}) GROUP BY ALL")
def q_confusion_multi(spark, sf):
    return M.confusion(multi_predictions(spark, sf))


@register("auc_binary", f"""
WITH p AS ({BIN_SQL}), r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0
  AS rk FROM p)
SELECT {rnd('(sum(CASE WHEN label = 1 THEN rk END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1) * count_if(label = 0))')} AS auc,
  CAST(count_if(label = 1) AS BIGINT) AS n_pos, CAST(count_if(label = 0) AS BIGINT) AS n_neg FROM r""")
def q_auc_binary(spark, sf):
    p = binary_predictions(spark, sf).withColumn("is_pos", F.col("label") == 1)
    return rounded(M.auc(p))


@register("auc_ovr_multiclass", f"""
WITH p AS (SELECT role AS label, 1.0 / (1 + turn) AS s_system, (turn % 2)::DOUBLE + turn / 100.0 AS s_assistant,
  (1 - turn % 2)::DOUBLE + turn / 50.0 AS s_user FROM conversations),
l AS (SELECT 'system' AS cls, s_system AS score, label = 'system' AS pos FROM p
  UNION ALL SELECT 'assistant', s_assistant, label = 'assistant' FROM p
  UNION ALL SELECT 'user', s_user, label = 'user' FROM p),
r AS (SELECT cls, pos, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM l),
a AS (SELECT cls, (sum(CASE WHEN pos THEN rk END) - count_if(pos) * (count_if(pos) + 1) / 2.0) / (count_if(pos) * count_if(NOT pos)) AS auc,
  count_if(pos) AS np FROM r GROUP BY cls)
SELECT {rnd('sum(auc * np) / sum(np)')} AS auc FROM a""")
def q_auc_ovr(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.col("turn")
    p = c.select(F.col("role").alias("label"), (F.lit(1.0) / (1 + t)).alias("s_system"),
                 ((t % 2).cast("double") + t / F.lit(100.0)).alias("s_assistant"),
                 ((1 - t % 2).cast("double") + t / F.lit(50.0)).alias("s_user"))
    return rounded(M.auc_ovr(p, "label", {"system": "s_system", "assistant": "s_assistant", "user": "s_user"}))


@register("roc_binary", f"""
WITH p AS ({BIN_SQL}), f AS (SELECT score AS threshold, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM p GROUP BY 1)
SELECT {rnd('threshold')} AS threshold,
  {rnd('sum(pos) OVER (ORDER BY threshold DESC) / (SELECT sum(pos) FROM f)')} AS tpr,
  {rnd('sum(neg) OVER (ORDER BY threshold DESC) / (SELECT sum(neg) FROM f)')} AS fpr FROM f""")
def q_roc_binary(spark, sf):
    p = binary_predictions(spark, sf).withColumn("is_pos", F.col("label") == 1)
    return rounded(M.roc_curve(p))


@register("regression_metrics_ols", f"""
WITH p AS ({OLS_SQL})
SELECT {rnd('avg(abs(label - prediction))', 4)} AS mae, {rnd('avg((label - prediction) ^ 2)', 2)} AS mse,
  {rnd('sqrt(avg((label - prediction) ^ 2))', 4)} AS rmse, {rnd('1 - avg((label - prediction) ^ 2) / var_pop(label)')} AS r2,
  {rnd('CASE WHEN count_if(label < 0 OR prediction < 0) = 0 THEN sqrt(avg((ln(1 + prediction) - ln(1 + label)) ^ 2)) END')} AS rmsle,
  {rnd('avg(abs(label - prediction) / greatest(abs(label), 2.220446049250313e-16))')} AS mape FROM p""")
def q_regression_metrics(spark, sf):
    m = M.regression_metrics(ols_predictions(spark, sf))
    return m.select(F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"),
                    *[F.round(c, 6).alias(c) for c in ("r2", "rmsle", "mape")])


@register("residuals_ols", f"""
WITH p AS ({OLS_SQL}) SELECT {', '.join(LINEITEM_KEY)}, {rnd('label', 2)} AS label, {rnd('prediction', 4)} AS prediction,
  {rnd('label - prediction', 4)} AS residual FROM p""")
def q_residuals(spark, sf):
    r = M.residuals(ols_predictions(spark, sf))
    return r.select(*LINEITEM_KEY, F.round("label", 2).alias("label"), F.round("prediction", 4).alias("prediction"),
                    F.round("residual", 4).alias("residual"))


@register("residual_stats_ols", f"""
WITH p AS ({OLS_SQL}) SELECT {rnd('avg(label - prediction)', 4)} AS mean, {rnd('stddev_samp(label - prediction)', 4)} AS std,
  {rnd('min(label - prediction)', 4)} AS min, {rnd('max(label - prediction)', 4)} AS max FROM p""")
def q_residual_stats(spark, sf):
    return rounded(M.residual_stats(ols_predictions(spark, sf)), 4)


@register("compare_unitprice_vs_ols", f"""
WITH o AS (SELECT avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) ^ 2)) AS rmse,
             1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2 FROM ({UNIT_SQL})),
t AS (SELECT avg(abs(label - prediction)) AS mae, sqrt(avg((label - prediction) ^ 2)) AS rmse,
             1 - avg((label - prediction) ^ 2) / var_pop(label) AS r2 FROM ({OLS_SQL})),
lo AS (SELECT unnest(['mae', 'rmse', 'r2']) AS metric, unnest([mae, rmse, r2]) AS v FROM o),
lt AS (SELECT unnest(['mae', 'rmse', 'r2']) AS metric, unnest([mae, rmse, r2]) AS v FROM t)
SELECT lo.metric, {rnd('lo.v', 4)} AS original, {rnd('lt.v', 4)} AS tuned,
  {rnd('CASE WHEN lo.v <> 0 THEN (lt.v - lo.v) / abs(lo.v) * 100 END', 4)} AS improvement_pct
FROM lo JOIN lt USING (metric)""")
def q_compare(spark, sf):
    def three(p):
        return M.regression_metrics(p).select("mae", "rmse", "r2")
    return rounded(M.compare_metrics(three(unit_price_predictions(spark, sf)), three(ols_predictions(spark, sf))), 4)
