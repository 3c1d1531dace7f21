"""Model explanation: exact linear contributions and sampled Shapley values.

- ``linear_contributions``: coef_j * (x_j - mean_j), one aggregate for the means
  and a projection - exact for linear models.
- ``shapley_sampled`` (Strumbelj & Kononenko 2014): for each row and each of
  ``n_perm`` seeded feature orders, d+1 hybrid rows switch features from a
  background point (column means) to the row's values one at a time; the model
  scores all hybrids in one ``transform``; differences of consecutive scores
  are attributed to the switched feature and averaged over orders. The row
  multiplier is n_perm x (d+1) - fixed by parameters - and every window is one
  (row, order) of d+1 hybrids.
- ``analysis_summary``: top features, prediction count, MAE / R2 and residual
  statistics as one long table.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators import metrics as M


def linear_contributions(df: DataFrame, features: list[str], coef, id_col: str) -> DataFrame:
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    st = [F.struct(F.lit(c).alias("feature"),
                   (F.lit(float(b)) * (F.col(c).cast("double") - F.lit(means[c]))).alias("contribution"))
          for c, b in zip(features, coef)]
    return df.select(F.col(id_col), F.inline(F.array(*st)))


def shapley_sampled(fitted, df: DataFrame, features: list[str], id_col: str, n_perm: int = 10,
                    seed: int = 42) -> DataFrame:
    d = len(features)
    bg = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in features]).first()
    rng = random.Random(seed)
    perms = [rng.sample(range(d), d) for _ in range(n_perm)]
    # position of feature j in permutation p: pos[p][j]
    pos = [[perm.index(j) for j in range(d)] for perm in perms]
    base = df.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(c) for c in features])
    steps = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("__p")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("__s"))
    posarr = F.array(*[F.array(*[F.lit(x) for x in row]) for row in pos])
    hyb = []
    for j, c in enumerate(features):
        switched = F.element_at(F.element_at(posarr, F.col("__p") + 1), j + 1) < F.col("__s")
        hyb.append(F.when(switched, F.col(c)).otherwise(F.lit(bg[c])).alias(c))
    h = steps.select("__id", "__p", "__s", *hyb)
    scored = fitted.transform(h).select("__id", "__p", "__s", F.col("prediction").cast("double").alias("__f"))
    w = Window.partitionBy("__id", "__p").orderBy("__s")
    permarr = F.array(*[F.array(*[F.lit(x) for x in perm]) for perm in perms])
    diff = (scored.withColumn("__prev", F.lag("__f").over(w)).where(F.col("__s") > 0)
            .withColumn("__j", F.element_at(F.element_at(permarr, F.col("__p") + 1), F.col("__s")))
            .select("__id", "__j", (F.col("__f") - F.col("__prev")).alias("phi")))
    names = F.array(*[F.lit(c) for c in features])
    return (diff.groupBy("__id", "__j").agg(F.avg("phi").alias("shap"))
            .select(F.col("__id").alias(id_col), F.element_at(names, F.col("__j") + 1).alias("feature"), "shap"))


def analysis_summary(importance: DataFrame, predictions: DataFrame, label: str = "label",
                     prediction: str = "prediction", top: int = 10) -> DataFrame:
    """Long ``(section, key, value)``: top features, prediction rows, MAE / R2 and residual statistics."""
    spark = predictions.sparkSession
    imp = [("top_feature", r["feature"], float(r["importance"]))
           for r in importance.orderBy(F.desc("importance"), "feature").limit(top).collect()]
    n = predictions.count()
    reg = M.regression_metrics(predictions, label, prediction).first()
    res = M.residual_stats(predictions, label, prediction).first()
    rows = imp + [("predictions", "rows", float(n)), ("metric", "mae", reg["mae"]), ("metric", "r2", reg["r2"])]
    rows += [("residual", k, res[k]) for k in ("mean", "std", "min", "max")]
    return spark.createDataFrame(rows, "section string, key string, value double")
