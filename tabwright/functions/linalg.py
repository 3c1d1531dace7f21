"""Gram aggregate: n, sum x, sum x x^T (and x^T y, y^T y) in one pass.

The result is d x d - small and independent of the row count - so solving,
inverting or eigen-decomposing it on the driver is bounded work. Each entry is
a plain ``sum`` with map-side partial aggregation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, features: list[str], target: str | None = None, weight: Column | None = None,
         where: Column | None = None) -> dict:
    d = len(features)
    x = [F.col(c).cast("double") for c in features]
    w = weight if weight is not None else F.lit(1.0)
    src = df.where(where) if where is not None else df
    ok = None
    for c in x + ([F.col(target).cast("double")] if target else []):
        ok = c.isNotNull() if ok is None else ok & c.isNotNull()
    src = src.where(ok)
    aggs = [F.sum(w).alias("n")]
    aggs += [F.sum(w * x[i]).alias(f"s{i}") for i in range(d)]
    aggs += [F.sum(w * x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    if target:
        y = F.col(target).cast("double")
        aggs += [F.sum(w * x[i] * y).alias(f"xy{i}") for i in range(d)]
        aggs += [F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("yy")]
    r = src.agg(*aggs).first()
    n = float(r["n"] or 0.0)
    s = np.array([r[f"s{i}"] or 0.0 for i in range(d)])
    P = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            P[i, j] = P[j, i] = r[f"p{i}_{j}"] or 0.0
    out = {"n": n, "sx": s, "xx": P}
    if target:
        out["xy"] = np.array([r[f"xy{i}"] or 0.0 for i in range(d)])
        out["sy"] = float(r["sy"] or 0.0)
        out["yy"] = float(r["yy"] or 0.0)
    return out


def mean_cov(g: dict, ddof: int = 1) -> tuple[np.ndarray, np.ndarray]:
    n = g["n"]
    mu = g["sx"] / n
    cov = (g["xx"] - n * np.outer(mu, mu)) / max(n - ddof, 1.0)
    return mu, cov


def quad_form(features: list[str], mu: np.ndarray, A: np.ndarray) -> Column:
    """(x - mu)^T A (x - mu) as a column expression (A small and dense)."""
    d = len(features)
    z = [F.col(c).cast("double") - F.lit(float(mu[i])) for i, c in enumerate(features)]
    terms = []
    for i in range(d):
        for j in range(i, d):
            a = A[i, i] if i == j else A[i, j] + A[j, i]
            if a != 0.0:
                terms.append(F.lit(float(a)) * z[i] * z[j])
    out = terms[0] if terms else F.lit(0.0)
    for t in terms[1:]:
        out = out + t
    return out


def linear(features: list[str], coef: np.ndarray, intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, b in zip(features, coef):
        out = out + F.lit(float(b)) * F.col(c).cast("double")
    return out
