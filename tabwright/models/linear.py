"""Linear-family and discriminant models fitted from Gram aggregates.

One pass computes n, sum x, X^T X, X^T y (per class where needed); every
solver below works on those d x d constants on the driver - exact and
independent of the row count - and scores with column expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.linalg import gram, linear
from tabwright.models.base import Fitted, Model


def _centered(g: dict):
    n = g["n"]
    mx = g["sx"] / n
    my = g["sy"] / n
    G = g["xx"] - n * np.outer(mx, mx)
    c = g["xy"] - n * mx * my
    yy = g["yy"] - n * my * my
    return n, mx, my, G, c, yy


def ols(G, c):
    return np.linalg.pinv(G) @ c


def ridge(G, c, alpha):
    return np.linalg.solve(G + alpha * np.eye(len(c)), c)


def lasso_cd(G, c, n, alpha, iters=1000, tol=1e-10):
    """Coordinate descent for (1/2n)|y - Xb|^2 + alpha |b|_1 on the centred Gram."""
    d = len(c)
    b = np.zeros(d)
    for _ in range(iters):
        old = b.copy()
        for j in range(d):
            if G[j, j] <= 0:
                continue
            rho = c[j] - G[j] @ b + G[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - n * alpha, 0.0) / G[j, j]
        if np.max(np.abs(b - old)) < tol:
            break
    return b


def lars(G, c, max_steps=None):
    """Least-angle regression on the centred Gram (covariance form).

    Each step moves along the equiangular direction of the active set until an
    inactive feature reaches the same absolute correlation; the full path ends
    at the least-squares fit.
    """
    d = len(c)
    steps = d if max_steps is None else min(max_steps, d)
    b = np.zeros(d)
    active: list[int] = []
    for _ in range(steps):
        corr = c - G @ b
        inactive = [j for j in range(d) if j not in active]
        if not inactive:
            break
        j = max(inactive, key=lambda t: abs(corr[t]))
        C = abs(corr[j])
        if C < 1e-12:
            break
        active.append(j)
        A = np.array(active)
        u = np.zeros(d)
        u[A] = np.linalg.pinv(G[np.ix_(A, A)]) @ np.sign(corr[A])
        a = G @ u  # on the active set a equals sign(corr): correlations shrink by gamma
        gamma = C
        for k in range(d):
            if k in active:
                continue
            for num, den in ((C - corr[k], 1.0 - a[k]), (C + corr[k], 1.0 + a[k])):
                if abs(den) > 1e-15 and 1e-15 < num / den < gamma:
                    gamma = num / den
        b = b + gamma * u
    return b


def omp(G, c, n_nonzero):
    d = len(c)
    active: list[int] = []
    b = np.zeros(d)
    for _ in range(max(1, min(n_nonzero, d))):
        r = c - G @ b
        j = int(np.argmax([abs(r[k]) if k not in active else -1 for k in range(d)]))
        active.append(j)
        A = np.array(active)
        b = np.zeros(d)
        b[A] = np.linalg.pinv(G[np.ix_(A, A)]) @ c[A]
    return b


def bayes_ridge(G, c, yy, n, iters=300, tol=1e-3):
    """Evidence maximisation (MacKay): alpha = noise precision, lam = weight precision."""
    d = len(c)
    ev, V = np.linalg.eigh(G)
    ev = np.clip(ev, 0, None)
    var_y = yy / n if n else 1.0
    alpha, lam = 1.0 / (var_y + 1e-12), 1.0
    b = np.zeros(d)
    for _ in range(iters):
        b_new = V @ ((V.T @ c) * alpha / (alpha * ev + lam))
        gamma = float(np.sum(alpha * ev / (alpha * ev + lam)))
        rss = float(yy - 2 * b_new @ c + b_new @ G @ b_new)
        lam = gamma / max(float(b_new @ b_new), 1e-300)
        alpha = (n - gamma) / max(rss, 1e-300)
        if np.sum(np.abs(b_new - b)) < tol:
            b = b_new
            break
        b = b_new
    return b


def ard(G, c, yy, n, iters=300, tol=1e-3, thresh=1e4):
    d = len(c)
    alpha = 1.0 / (yy / n + 1e-12) if n else 1.0
    lam = np.ones(d)
    keep = np.ones(d, dtype=bool)
    b = np.zeros(d)
    for _ in range(iters):
        K = np.where(keep)[0]
        S = np.linalg.pinv(alpha * G[np.ix_(K, K)] + np.diag(lam[K]))
        bk = alpha * S @ c[K]
        b_new = np.zeros(d)
        b_new[K] = bk
        gamma = 1 - lam[K] * np.diag(S)
        lam[K] = gamma / np.clip(bk ** 2, 1e-300, None)
        rss = float(yy - 2 * b_new @ c + b_new @ G @ b_new)
        alpha = (n - gamma.sum()) / max(rss, 1e-300)
        keep = lam < thresh
        if np.sum(np.abs(b_new - b)) < tol:
            b = b_new
            break
        b = b_new
    return b


@dataclass
class LinearFitted(Fitted):
    model_id: str
    features: list[str]
    coef: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", linear(self.features, self.coef, self.intercept))

    def importances(self):
        return sorted(zip(self.features, map(float, np.abs(self.coef))), key=lambda t: (-t[1], t[0]))


@dataclass
class GramRegressor(Model):
    """lr (OLS), ridge (closed form), lar, llar (lasso), omp, br, ard."""

    def fit(self, df, features, label=None):
        return self.fit_from_gram(gram(df, features, label), features)

    def fit_from_gram(self, g: dict, features: list[str]) -> LinearFitted:
        n, mx, my, G, c, yy = _centered(g)
        k = self.model_id
        p = self.params
        if k == "lr":
            b = ols(G, c)
        elif k == "ridge":
            b = ridge(G, c, p.get("alpha", 1.0))
        elif k in ("lasso", "llar"):
            b = lasso_cd(G, c, n, p.get("alpha", 1.0))
        elif k == "en":
            a, l1 = p.get("alpha", 1.0), p.get("l1_ratio", 0.5)
            b = lasso_cd(G + n * a * (1 - l1) * np.eye(len(c)), c, n, a * l1)
        elif k == "lar":
            b = lars(G, c, p.get("n_nonzero_coefs"))
        elif k == "omp":
            b = omp(G, c, p.get("n_nonzero_coefs") or max(int(0.1 * len(c)), 1))
        elif k == "br":
            b = bayes_ridge(G, c, yy, n)
        elif k == "ard":
            b = ard(G, c, yy, n)
        else:
            raise ValueError(k)
        return LinearFitted(k, features, b, float(my - mx @ b))


# ---------------------------------------------------------------- robust regressors

@dataclass
class Ransac(Model):
    """Candidate OLS fits on small hash-drawn samples, all scored in one scan by inlier count; refit on inliers."""

    def fit(self, df, features, label=None):
        from tabwright.functions.quantiles import quantile_dict
        d = len(features)
        trials = self.params.get("max_trials", 100)
        seed = self.params.get("seed", 42)
        m = d + 1
        n = df.count()
        frac = min(1.0, 3.0 * m / max(n, 1))
        rowh = F.xxhash64(*[F.col(c) for c in features + [label]])
        draws = F.filter(F.sequence(F.lit(0), F.lit(trials - 1)),
                         lambda t: F.pmod(F.xxhash64(rowh, t, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(frac))
        samp = (df.select(*features, label, rowh.alias("__h"), F.explode(draws).alias("t"))
                .withColumn("__h", F.xxhash64("__h", "t")).collect())  # ~3(d+1) rows per trial: bounded
        by: dict = {}
        for r in sorted(samp, key=lambda r: (r["t"], r["__h"], str(r))):  # the lowest hashes, not the first to arrive
            by.setdefault(r["t"], []).append(r)
        cands = []
        for t, rows in sorted(by.items()):
            if len(rows) < m:
                continue
            X = np.array([[1.0] + [float(r[c]) for c in features] for r in rows[:m]])
            y = np.array([float(r[label]) for r in rows[:m]])
            cands.append(np.linalg.pinv(X) @ y)
        if not cands:
            return GramRegressor("lr", "regression", "").fit(df, features, label)
        q = quantile_dict(df, [label], [0.5])[(label, 0.5)]
        mad_df = df.select(F.abs(F.col(label).cast("double") - F.lit(q)).alias("a"))
        thr = self.params.get("residual_threshold") or quantile_dict(mad_df, ["a"], [0.5])[("a", 0.5)]
        pred = [linear(features, w[1:], w[0]) for w in cands]
        y = F.col(label).cast("double")
        counts = df.agg(*[F.sum((F.abs(y - p) <= F.lit(thr)).cast("int")).alias(f"c{i}")
                          for i, p in enumerate(pred)]).first()
        best = max(range(len(cands)), key=lambda i: (counts[f"c{i}"], -i))
        inl = F.abs(y - pred[best]) <= F.lit(thr)
        g = gram(df, features, label, where=inl)
        n_, mx, my, G, c, yy = _centered(g)
        b = ols(G, c)
        return LinearFitted("ransac", features, b, float(my - mx @ b))


@dataclass
class TheilSen(Model):
    """OLS on many small hash-keyed subsets (``applyInPandas``, bounded size each), spatial median of the fits."""

    def fit(self, df, features, label=None):
        import pandas as pd
        d = len(features)
        m = d + 1
        n = df.count()
        n_sub = int(min(self.params.get("max_subpopulation", 10000), max(1, n // m)))
        seed = self.params.get("seed", 42)
        rowh = F.xxhash64(*[F.col(c) for c in features + [label]], F.lit(seed))
        frac = min(1.0, n_sub * m * 1.5 / max(n, 1))
        sub = df.where(F.pmod(rowh, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(frac)).select(
            F.pmod(F.xxhash64(rowh, F.lit(1)), F.lit(n_sub)).alias("s"), rowh.alias("__h"), *features, label)

        def fit_one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["__h", *features, label]).head(m)  # the lowest hashes, not the first to arrive
            if len(pdf) < m:
                return pd.DataFrame({"s": pd.Series([], dtype="int64"), "w": pd.Series([], dtype=object)})
            X = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in features])
            w = np.linalg.pinv(X) @ pdf[label].to_numpy(float)
            return pd.DataFrame({"s": pd.Series([int(pdf["s"].iloc[0])], dtype="int64"),
                                 "w": pd.Series([[float(x) for x in w]], dtype=object)})

        W = np.array([r["w"] for r in sub.groupBy("s").applyInPandas(fit_one, "s long, w array<double>").collect()])
        if len(W) == 0:
            return GramRegressor("lr", "regression", "").fit(df, features, label)
        z = W.mean(axis=0)
        for _ in range(300):  # Weiszfeld iterations for the spatial median
            dist = np.linalg.norm(W - z, axis=1)
            dist = np.where(dist < 1e-12, 1e-12, dist)
            z_new = (W / dist[:, None]).sum(axis=0) / (1.0 / dist).sum()
            if np.linalg.norm(z_new - z) < 1e-9:
                z = z_new
                break
            z = z_new
        return LinearFitted("tr", features, z[1:], float(z[0]))


@dataclass
class LinearSVR(Model):
    """Epsilon-insensitive linear regression by subgradient descent; one aggregate per step."""

    def fit(self, df, features, label=None):
        from tabwright.functions.linalg import mean_cov
        d = len(features)
        C = self.params.get("C", 1.0)
        eps = self.params.get("epsilon", 0.0)
        steps = self.params.get("steps", 50)
        g = gram(df, features, label)
        mu, cov = mean_cov(g)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
        n = g["n"]
        my = g["sy"] / n
        sy = math.sqrt(max(g["yy"] / n - my * my, 1e-12))
        xs = [(F.col(c).cast("double") - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i, c in enumerate(features)]
        ys = (F.col(label).cast("double") - F.lit(my)) / F.lit(sy)
        z = df.select(F.array(*xs).alias("x"), ys.alias("y")).cache()
        w = np.zeros(d)
        b = 0.0
        for t in range(steps):
            wl = F.array(*[F.lit(float(v)) for v in w])
            r = F.col("y") - F.aggregate(F.zip_with("x", wl, lambda a, c: a * c), F.lit(b), lambda s, v: s + v)
            sg = F.when(r > eps, -1.0).when(r < -eps, 1.0).otherwise(0.0)
            row = z.select(sg.alias("g"), "x").agg(F.sum("g").alias("gb"),
                                                    *[F.sum(F.col("g") * F.col("x")[j]).alias(f"g{j}") for j in range(d)]).first()
            gw = w / (C * n) + np.array([row[f"g{j}"] or 0.0 for j in range(d)]) / n
            gb = (row["gb"] or 0.0) / n
            step = 1.0 / math.sqrt(t + 1)
            w, b = w - step * gw, b - step * gb
        z.unpersist()
        coef = w * sy / sd
        return LinearFitted("svm", features, coef, float(my + sy * b - coef @ mu))


# ---------------------------------------------------------------- random Fourier features

def rff_columns(features: list[str], mu, sd, n_components: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    d = len(features)
    W = rng.normal(0, math.sqrt(2 * gamma), size=(n_components, d))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    xs = [(F.col(c).cast("double") - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i, c in enumerate(features)]
    s = math.sqrt(2.0 / n_components)
    cols = []
    for j in range(n_components):
        e = F.lit(float(b[j]))
        for i in range(d):
            e = e + F.lit(float(W[j, i])) * xs[i]
        cols.append((F.lit(s) * F.cos(e)).alias(f"__rff{j}"))
    return cols


@dataclass
class RFFFitted(Fitted):
    model_id: str
    features: list[str]
    mu: np.ndarray
    sd: np.ndarray
    n_components: int
    gamma: float
    seed: int
    inner: Fitted

    def transform(self, df):
        z = rff_columns(self.features, self.mu, self.sd, self.n_components, self.gamma, self.seed)
        out = self.inner.transform(df.select("*", *z))
        return out.drop(*[f"__rff{j}" for j in range(self.n_components)])


@dataclass
class RFFModel(Model):
    """Kernel method approximated by random Fourier features (Rahimi & Recht): kr (ridge) or rbfsvm (linear SVM)."""
    inner_factory: object = None

    def with_params(self, **p):
        q = dict(self.params)
        q.update(p)
        return RFFModel(self.model_id, self.problem, self.title, self.approximate, q, self.inner_factory)

    def fit(self, df, features, label=None):
        from tabwright.functions.linalg import mean_cov
        D = self.params.get("n_components", 64)
        gamma = self.params.get("gamma") or 1.0 / max(len(features), 1)
        seed = self.params.get("seed", 42)
        mu, cov = mean_cov(gram(df, features))
        sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
        z = rff_columns(features, mu, sd, D, gamma, seed)
        zdf = df.select(*[F.col(c) for c in df.columns], *z)
        names = [f"__rff{j}" for j in range(D)]
        inner = self.inner_factory().fit(zdf, names, label)
        return RFFFitted(self.model_id, features, mu, sd, D, gamma, seed, inner)


# ---------------------------------------------------------------- discriminants and ridge classifier

@dataclass
class DiscriminantFitted(Fitted):
    model_id: str
    features: list[str]
    classes: list
    A: list  # per-class quadratic matrices (None for LDA)
    w: list  # per-class linear terms
    c0: list  # per-class constants

    def transform(self, df):
        d = len(self.features)
        x = [F.col(f).cast("double") for f in self.features]
        scores = []
        for k in range(len(self.classes)):
            s = F.lit(float(self.c0[k]))
            for i in range(d):
                s = s + F.lit(float(self.w[k][i])) * x[i]
            if self.A[k] is not None:
                A = self.A[k]
                for i in range(d):
                    for j in range(i, d):
                        a = A[i][i] if i == j else A[i][j] + A[j][i]
                        if a != 0:
                            s = s + F.lit(float(a)) * x[i] * x[j]
            scores.append(s)
        # columns of their own: an expression used inside a lambda is evaluated for every element
        out = df.withColumn("__s", F.array(*scores)).withColumn("__mx", F.array_max("__s"))
        out = out.withColumn("__ex", F.transform("__s", lambda v: F.exp(v - F.col("__mx"))))
        out = out.withColumn("__tot", F.aggregate("__ex", F.lit(0.0), lambda a, v: a + v))
        out = (out.withColumn("probability", F.transform("__ex", lambda v: v / F.col("__tot")))
               .withColumn("prediction", (F.array_position("__s", F.col("__mx")) - 1).cast("double"))
               .drop("__s", "__mx", "__ex", "__tot"))
        return out.withColumn("score", F.when(F.size("probability") >= 2, F.col("probability")[1]))

    def importances(self):
        v = np.abs(np.array(self.w[0]))
        return sorted(zip(self.features, map(float, v)), key=lambda t: (-t[1], t[0]))


def _class_grams(df, features, label):
    d = len(features)
    x = [F.col(c).cast("double") for c in features]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    aggs += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = df.groupBy(label).agg(*aggs).orderBy(label).collect()  # one row per class: bounded by classes
    out = []
    for r in rows:
        n = float(r["n"])
        s = np.array([r[f"s{i}"] for i in range(d)])
        P = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                P[i, j] = P[j, i] = r[f"p{i}_{j}"]
        out.append((r[label], n, s, P))
    return out


@dataclass
class Discriminant(Model):
    """lda (pooled covariance) / qda (per-class covariance, reg_param) from one per-class Gram aggregate."""

    def fit(self, df, features, label=None):
        cg = _class_grams(df, features, label)
        N = sum(n for _, n, _, _ in cg)
        d = len(features)
        classes, A, w, c0 = [], [], [], []
        if self.model_id == "lda":
            S = np.zeros((d, d))
            for _, n, s, P in cg:
                m = s / n
                S += P - n * np.outer(m, m)
            S /= max(N - len(cg), 1)
            Si = np.linalg.pinv(S)
            for k, n, s, _ in cg:
                m = s / n
                classes.append(k)
                A.append(None)
                w.append((Si @ m).tolist())
                c0.append(float(-0.5 * m @ Si @ m + math.log(n / N)))
        else:
            reg = self.params.get("reg_param", 0.0)
            for k, n, s, P in cg:
                m = s / n
                C = (P - n * np.outer(m, m)) / max(n - 1, 1)
                C = (1 - reg) * C + reg * np.eye(d)
                Ci = np.linalg.pinv(C)
                sign, logdet = np.linalg.slogdet(C)
                classes.append(k)
                A.append((-0.5 * Ci).tolist())
                w.append((Ci @ m).tolist())
                c0.append(float(-0.5 * m @ Ci @ m - 0.5 * (logdet if sign > 0 else 0.0) + math.log(n / N)))
        return DiscriminantFitted(self.model_id, features, classes, A, w, c0)


@dataclass
class RidgeClassifier(Model):
    """One-vs-rest ridge on +/-1 targets; one Gram aggregate with a target sum per class."""

    def fit(self, df, features, label=None):
        alpha = self.params.get("alpha", 1.0)
        d = len(features)
        x = [F.col(c).cast("double") for c in features]
        classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
        g = gram(df, features)
        n = g["n"]
        mx = g["sx"] / n
        G = g["xx"] - n * np.outer(mx, mx)
        y = F.col(label)
        aggs = []
        for k, cl in enumerate(classes):
            t = F.when(y == F.lit(cl), 1.0).otherwise(-1.0)
            aggs += [F.sum(t).alias(f"t{k}")] + [F.sum(t * x[i]).alias(f"x{k}_{i}") for i in range(d)]
        r = df.agg(*aggs).first()
        W, C0 = [], []
        for k in range(len(classes)):
            mt = r[f"t{k}"] / n
            c = np.array([r[f"x{k}_{i}"] for i in range(d)]) - n * mx * mt
            b = np.linalg.solve(G + alpha * np.eye(d), c)
            W.append(b.tolist())
            C0.append(float(mt - mx @ b))
        if len(classes) == 2:  # binary: one decision function, sign picks the class
            W = [[-v for v in W[1]], W[1]]
            C0 = [-C0[1], C0[1]]
        return DiscriminantFitted("ridge", features, classes, [None] * len(classes), W, C0)



VAR_SMOOTHING = 1e-9  # fixed value: share of the largest feature variance added to every variance


@dataclass
class GaussianNB(Model):
    """Gaussian naive Bayes: per-class means and population variances (+ smoothing), log priors.

    One per-class aggregate; scores are quadratic column expressions with a diagonal matrix."""

    def fit(self, df, features, label=None):
        cg = _class_grams(df, features, label)
        d = len(features)
        N = sum(n for _, n, _, _ in cg)
        tot_s = sum(s for _, _, s, _ in cg)
        tot_p = sum(P for _, _, _, P in cg)
        mu_all = tot_s / N
        var_all = np.diag(tot_p) / N - mu_all ** 2
        eps = self.params.get("var_smoothing", VAR_SMOOTHING) * float(np.max(var_all)) if d else 0.0
        classes, A, w, c0 = [], [], [], []
        for k, n, s, P in cg:
            m = s / n
            v = np.diag(P) / n - m ** 2 + eps
            classes.append(k)
            A.append(np.diag(-0.5 / v).tolist())
            w.append((m / v).tolist())
            c0.append(float(math.log(n / N) - 0.5 * np.sum(np.log(2 * math.pi * v)) - 0.5 * np.sum(m * m / v)))
        return DiscriminantFitted("nb", features, classes, A, w, c0)
