"""Feature selection.

Univariate scores are one aggregate over the unpivoted features: per (feature,
class) counts, sums and squares (ANOVA F), or per-feature co-moments
(regression F). RFE and Boruta loop over Spark ML forests (see ``select_model``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anova_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One-way ANOVA F of each numeric feature across the classes of ``target``: (feature, f_score)."""
    long = (df.select(F.col(target).alias("__y"), *[F.col(c).cast("double").alias(c) for c in features])
            .unpivot(["__y"], features, "feature", "x").where(F.col("x").isNotNull()))
    g = long.groupBy("feature", "__y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"),
                                          F.sum(F.col("x") * F.col("x")).alias("ss"))
    # g has features x classes rows; the second level is tiny.
    t = g.groupBy("feature").agg(
        F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("ss").alias("SS"), F.count(F.lit(1)).alias("G"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    ssb = F.col("B") - F.col("S") * F.col("S") / F.col("N")
    ssw = F.col("SS") - F.col("B")
    return t.select("feature", F.when((F.col("G") > 1) & (F.col("N") > F.col("G")),
                                      (ssb / (F.col("G") - 1)) / (ssw / (F.col("N") - F.col("G")))).alias("f_score"))


def regression_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """F statistic of a univariate linear fit of ``target`` on each feature: r^2/(1-r^2)*(n-2)."""
    y = F.col(target).cast("double")
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        ok = x.isNotNull() & y.isNotNull()
        aggs += [F.corr(F.when(ok, x), F.when(ok, y)).alias(f"r{i}"), F.count(F.when(ok, 1)).alias(f"n{i}")]
    r = df.agg(*aggs)
    st = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
          for i, c in enumerate(features)]
    e = r.select(F.inline(F.array(*st)))
    return e.select("feature", (F.col("r") * F.col("r") / (1 - F.col("r") * F.col("r")) * (F.col("n") - 2)).alias("f_score"))


def univariate_select(df: DataFrame, features: list[str], target: str, k: int, classification: bool) -> DataFrame:
    """Scores ranked best first with a ``selected`` flag for the top ``k`` (ties by name)."""
    s = anova_f(df, features, target) if classification else regression_f(df, features, target)
    w = Window.orderBy(F.desc_nulls_last("f_score"), "feature")  # one row per feature: tiny
    return s.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)
