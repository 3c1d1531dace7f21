"""Model evaluation tables computed from prediction DataFrames.

Classification metrics come from the confusion counts ``(label, prediction, n)``
- one partial-aggregated ``groupBy`` - so every later step works on a table of
classes x classes rows. AUC and ROC use score frequency tables and the
distributed running totals of ``functions.running``. Regression metrics are one
aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.running import running_totals

MAPE_EPS = 2.220446049250313e-16  # fixed value: float64 machine epsilon guarding |y| in MAPE

CLASSIFICATION_METRICS = ("accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc")
REGRESSION_METRICS = ("mae", "mse", "rmse", "r2", "rmsle", "mape")
ASCENDING = {"mae", "mse", "rmse", "rmsle", "mape"}


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return (pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def _per_class(cm: DataFrame) -> DataFrame:
    """(cls, tp, support, predicted) over the union of labels and predictions."""
    a = cm.select(F.col("label").alias("cls"), F.when(F.col("label") == F.col("prediction"), F.col("n"))
                  .otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"))
    b = cm.select(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                  F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"))
    return (a.unionByName(b).groupBy("cls")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision / recall / F1 / support (zero-division -> 0)."""
    pc = _per_class(confusion(pred, label, prediction))
    p = _safe_div(F.col("tp").cast("double"), F.col("predicted"))
    r = _safe_div(F.col("tp").cast("double"), F.col("support"))
    return (pc.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .select(F.col("cls").cast("string").alias("cls"), "precision", "recall", "f1", "support"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, weighted precision / recall / F1, Cohen's kappa, Matthews correlation."""
    pc = _per_class(confusion(pred, label, prediction))
    p = _safe_div(F.col("tp").cast("double"), F.col("predicted"))
    r = _safe_div(F.col("tp").cast("double"), F.col("support"))
    f1 = _safe_div(2 * p * r, p + r)
    t = pc.agg(F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("s"),
               F.sum(F.col("support") * p).alias("wp"), F.sum(F.col("support") * r).alias("wr"),
               F.sum(F.col("support") * f1).alias("wf"),
               F.sum(F.col("support").cast("double") * F.col("predicted")).alias("pt"),
               F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
               F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"))
    s = F.col("s")
    pe = F.col("pt") / (s * s)
    po = F.col("c") / s
    mcc_den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return t.select(
        _safe_div(F.col("c"), s).alias("accuracy"), _safe_div(F.col("wp"), s).alias("precision"),
        _safe_div(F.col("wr"), s).alias("recall"), _safe_div(F.col("wf"), s).alias("f1"),
        F.when(pe != 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"),
        _safe_div(F.col("c") * s - F.col("pt"), mcc_den).alias("mcc"))


def auc(scores: DataFrame, score: str = "score", positive: str = "is_pos", group: list[str] = ()) -> DataFrame:
    """Area under ROC by tie-averaged ranks (Mann-Whitney), per group: (group..., auc, n_pos, n_neg).

    Rows are first reduced to one per (group, score) with positive/negative counts;
    the count of negatives below each score is a distributed running total.
    """
    group = list(group)
    f = (scores.groupBy(*group, F.col(score).cast("double").alias("__s"))
         .agg(F.sum(F.col(positive).cast("int")).cast("bigint").alias("pos"),
              F.sum(1 - F.col(positive).cast("int")).cast("bigint").alias("neg")))
    rt = running_totals(f, "__s", ["neg"], group)
    gb = rt.groupBy(*group) if group else rt.groupBy()
    a = gb.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)).alias("u"),
               F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return a.select(*group, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                   F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def auc_ovr(pred: DataFrame, label: str, prob_cols: dict) -> DataFrame:
    """Multiclass AUC: one-vs-rest per class weighted by class support. ``prob_cols``: class -> score column."""
    # one read of the predictions: a row per class, which goes by its place
    names = F.array(*[F.lit(str(c)) for c in prob_cols])
    scores = F.array(*[F.col(c).cast("double") for c in prob_cols.values()])
    long = pred.select(F.col(label).cast("string").alias("__y"), F.posexplode(scores).alias("cls", "score"))
    per = auc(long.select("cls", "score", (F.col("__y") == F.get(names, F.col("cls"))).alias("is_pos")), group=["cls"])
    return per.agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("n_pos"))))
                   .alias("auc"))


def roc_curve(scores: DataFrame, score: str = "score", positive: str = "is_pos") -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score, highest threshold first."""
    f = (scores.groupBy(F.col(score).cast("double").alias("threshold"))
         .agg(F.sum(F.col(positive).cast("int")).cast("bigint").alias("pos"),
              F.sum(1 - F.col(positive).cast("int")).cast("bigint").alias("neg")))
    rt = running_totals(f, "threshold", ["pos", "neg"], descending=True)
    tot = f.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = F.lit(tot["P"] or 0), F.lit(tot["N"] or 0)
    return rt.select("threshold", _safe_div(F.col("cum_pos").cast("double"), P).alias("tpr"),
                     _safe_div(F.col("cum_neg").cast("double"), N).alias("fpr"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: MAE, MSE, RMSE, R2, RMSLE (NULL if any value is negative), MAPE."""
    y = F.col(label).cast("double")
    p = F.col(prediction).cast("double")
    e = y - p
    t = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                 F.var_pop(y).alias("vy"),
                 F.avg(F.pow(F.log1p(p) - F.log1p(y), 2)).alias("msle"),
                 F.sum(((y < 0) | (p < 0)).cast("int")).alias("neg"),
                 F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(MAPE_EPS))).alias("mape"))
    return t.select("mae", "mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy")).alias("r2"),
                    F.when(F.col("neg") == 0, F.sqrt("msle")).alias("rmsle"), "mape")


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", F.col(label).cast("double") - F.col(prediction).cast("double"))


def residual_stats(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    r = F.col(label).cast("double") - F.col(prediction).cast("double")
    return pred.agg(F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"),
                    F.max(r).alias("max"))


def long_metrics(wide: DataFrame) -> DataFrame:
    """One-row metric table -> (metric, value)."""
    st = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns]
    return wide.select(F.inline(F.array(*st)))


def compare_metrics(original: DataFrame, tuned: DataFrame) -> DataFrame:
    """(metric, original, tuned, improvement_pct); improvement skipped when the original is 0."""
    o = long_metrics(original).withColumnRenamed("value", "original")
    t = long_metrics(tuned).withColumnRenamed("value", "tuned")
    return (o.join(t, "metric")
            .withColumn("improvement_pct", F.when(F.col("original") != 0,
                                                  (F.col("tuned") - F.col("original")) / F.abs(F.col("original")) * 100)))


def leaderboard_summary(board: DataFrame, metric: str, top: int = 5) -> DataFrame:
    """Best ``top`` models by ``metric`` (direction by metric) with the model count."""
    order = F.asc(metric) if metric in ASCENDING else F.desc(metric)
    n = board.count()
    return board.orderBy(order, "model").limit(top).withColumn("n_models", F.lit(n))
