"""Anomaly detectors returning ``(id, score)`` (higher = more outlying) and outlier removal.

- hbos: equal-width histograms per feature (one aggregate for the ranges, one
  ``groupBy(feature, bin)``), score = -sum log(bin share).
- pca: covariance from the Gram aggregate, eigen-decomposition on the driver
  (d x d), score = sum_j proj_j^2 / lambda_j (Mahalanobis in component space).
- mcd: random starts concentrated on a bounded sample (lowest hashes of the ids),
  the best one concentrated on all rows until the determinant stops falling.
- cluster: KMeans; large clusters hold ``alpha`` of the rows; points of small
  clusters are scored by their distance to the nearest large centre.
- iforest: trees of 256-row samples drawn by hash (about 256 rows per tree are
  emitted; never all rows x trees), built per tree in ``applyInPandas``,
  broadcast (bounded: trees x 2^depth nodes) and applied with a pandas UDF.
- ocsvm: approximate one-class SVM on random Fourier features, a subgradient
  loop with one aggregate per step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.linalg import gram, mean_cov, quad_form
from tabwright.functions.quantiles import quantile_dict
from tabwright.session import cut_lineage

ISO_SAMPLE = 256  # fixed value: rows per isolation tree
MCD_SAMPLE = 5_000  # rows on which the starts of the minimum covariance determinant are tried
MCD_STARTS = 100
EULER = 0.5772156649  # fixed value: Euler-Mascheroni constant for the average path length


def hbos(df: DataFrame, features: list[str], bins: int = 10, id_col: str = "id") -> DataFrame:
    r = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(features)],
               *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(features)],
               F.count(F.lit(1)).alias("n")).first()
    n = r["n"]
    bcols = []
    for i, c in enumerate(features):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        span = (hi - lo) if hi is not None and hi != lo else None
        x = F.col(c).cast("double")
        b = (F.least(F.floor((x - F.lit(lo)) / F.lit(span) * bins), F.lit(bins - 1)) if span else F.lit(0)).cast("int")
        bcols.append(F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(b).alias(f"__b{i}"))  # nulls: a bin of their own
    binned = df.select(F.col(id_col).alias("id"), *bcols)
    long = binned.unpivot(["id"], [f"__b{i}" for i in range(len(features))], "feature", "bin")
    hist = long.groupBy("feature", "bin").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("p"))
    # hist has features x bins rows: broadcast is bounded by construction.
    return (long.join(F.broadcast(hist), ["feature", "bin"])
            .groupBy("id").agg((-F.sum(F.log("p"))).alias("score")).withColumnRenamed("id", id_col))


def pca_score(df: DataFrame, features: list[str], id_col: str = "id", standardize: bool = True) -> DataFrame:
    g = gram(df, features)
    mu, cov = mean_cov(g)
    if standardize:
        s = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
        corr = cov / np.outer(s, s)
        lam, vec = np.linalg.eigh(corr)
        D = np.diag(1.0 / s)
        A = D @ vec @ np.diag(1.0 / np.clip(lam, 1e-12, None)) @ vec.T @ D
    else:
        lam, vec = np.linalg.eigh(cov)
        A = vec @ np.diag(1.0 / np.clip(lam, 1e-12, None)) @ vec.T
    return df.select(F.col(id_col), quad_form(features, mu, A).alias("score"))


def _concentrate(x: np.ndarray, mu: np.ndarray, cov: np.ndarray, support: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the rows nearest to (mu, cov), as many as ``support`` says."""
    z = x - mu
    m = np.einsum("ij,jk,ik->i", z, np.linalg.pinv(cov, hermitian=True), z)
    own = x[m <= np.quantile(m, support)]
    return own.mean(0), np.atleast_2d(np.cov(own, rowvar=False))


def _mcd_start(x: np.ndarray, support: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of ``MCD_STARTS`` draws of d + 1 rows, and of all rows: two steps each, the ten best to their end."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    drawn = [x, *(x[rng.choice(n, min(n, d + 1), replace=False)] for _ in range(MCD_STARTS))]

    def steps(fit, most):
        size = np.inf
        for _ in range(most):
            new = _concentrate(x, *fit, support)
            new_size = np.linalg.slogdet(new[1])[1]
            if not new_size < size:
                break
            fit, size = new, new_size
        return size, fit

    tried = sorted((steps((y.mean(0), np.atleast_2d(np.cov(y, rowvar=False))), 2) for y in drawn), key=lambda t: t[0])
    return min((steps(fit, 100) for _, fit in tried[:10]), key=lambda t: t[0])[1]


def mcd_fit(df: DataFrame, features: list[str], id_col: str = "id", support: float | None = None, steps: int = 30,
            seed: int = 42) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and covariance of the rows of least determinant; None without a complete row.

    Plain concentration from the mean of all rows can be held by a far group of outliers, so the start is chosen on at
    most ``MCD_SAMPLE`` rows. Every later step takes all rows: the exact quantile of their distances, then one
    aggregate. Steps never raise the determinant and end when it stops falling, after few from a good start.
    """
    d = len(features)
    x = df.select(F.col(id_col), *[F.col(c).cast("double").alias(c) for c in features])
    for c in features:
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    drawn = x.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col, *features).limit(MCD_SAMPLE).toPandas()
    sample = drawn[features].to_numpy(float)
    if not len(sample):
        return None
    n = len(sample) if len(sample) < MCD_SAMPLE else x.count()
    h = support if support is not None else min(1.0, (n + d + 1) / (2.0 * n))
    if len(sample) < 2:
        return sample.mean(0), np.zeros((d, d))
    mu, cov = _mcd_start(sample, h, seed)
    size = np.inf
    for _ in range(steps):
        m = quad_form(features, mu, np.linalg.pinv(cov, hermitian=True))
        cut = quantile_dict(x.select(m.alias("__m")), ["__m"], [h])[("__m", h)]
        new_mu, new_cov = mean_cov(gram(x, features, where=m <= F.lit(cut)))
        new_size = np.linalg.slogdet(new_cov)[1]
        if not new_size < size - 1e-9:
            break
        mu, cov, size = new_mu, new_cov, new_size
    return mu, cov


def mcd(df: DataFrame, features: list[str], id_col: str = "id", support: float | None = None, steps: int = 30,
        seed: int = 42) -> DataFrame:
    """Minimum covariance determinant: score = robust Mahalanobis distance^2; null for rows with a gap."""
    fit = mcd_fit(df, features, id_col, support, steps, seed)
    if fit is None:
        return df.select(F.col(id_col), F.lit(None).cast("double").alias("score"))
    score = quad_form(features, fit[0], np.linalg.pinv(fit[1], hermitian=True))
    return df.select(F.col(id_col), F.when(~F.isnan(score), score).alias("score"))


def cluster_score(df: DataFrame, features: list[str], id_col: str = "id", k: int = 8, alpha: float = 0.9,
                  beta: float = 5.0, seed: int = 42) -> DataFrame:
    """Cluster-based local outlier score (unweighted)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="skip")  # scored below, with null
    x = va.transform(df.select(id_col, *features))
    model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="__c").fit(x)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    pred = model.transform(x)
    sizes = {r["__c"]: r["n"] for r in pred.groupBy("__c").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(sizes, key=lambda c: -sizes[c])
    total = sum(sizes.values())
    large, acc = set(), 0
    for i, c in enumerate(order):
        large.add(c)
        acc += sizes[c]
        nxt = order[i + 1] if i + 1 < len(order) else None
        if acc >= alpha * total or (nxt is not None and sizes[c] / max(sizes[nxt], 1) >= beta):
            break
    def dist_to(ci):
        return F.sqrt(sum((F.col(f).cast("double") - F.lit(centers[ci][j])) ** 2 for j, f in enumerate(features)))
    own = F.lit(None).cast("double")
    for c in range(len(centers)):
        own = F.when(F.col("__c") == c, dist_to(c)).otherwise(own)
    nearest_large = F.least(*[dist_to(c) for c in large]) if len(large) > 1 else dist_to(next(iter(large)))
    score = F.when(F.col("__c").isin(list(large)), own).otherwise(nearest_large)
    scored = pred.select(F.col(id_col), score.alias("score"))
    return scored.unionByName(incomplete(df, features).select(F.col(id_col), F.lit(None).cast("double").alias("score")))


def incomplete(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with a null or NaN feature, which no distance-based model can place."""
    missing = F.lit(False)
    for c in features:
        x = F.col(c).cast("double")
        missing = missing | x.isNull() | F.isnan(x)
    return df.where(missing)


TASK_ROWS = 50_000  # rows of a task in the work that costs far more than reading the row, about


def _spread(df: DataFrame, n: int) -> DataFrame:
    """The same ``n`` rows in tasks of about ``TASK_ROWS``: a file of narrow rows is one task's read otherwise."""
    return df.repartition(-(-n // TASK_ROWS)) if n > TASK_ROWS else df


def _c(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def iforest(df: DataFrame, features: list[str], id_col: str = "id", n_trees: int = 100, seed: int = 42,
            sample: int = ISO_SAMPLE) -> DataFrame:
    d = len(features)
    n = df.count()
    df = _spread(df.select(id_col, *[c for c in dict.fromkeys(features) if c != id_col]), n)
    psi = min(sample, n)
    frac = min(1.0, 1.25 * psi / max(n, 1))
    x = F.array(*[F.col(c).cast("double") for c in features])
    # each row joins a tree with probability frac (hash of id and tree): about psi rows per tree
    draws = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: (F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
                     < F.lit(frac))
    samp = df.select(x.alias("x"), F.explode(draws).alias("tree"),
                     F.xxhash64(F.col(id_col), F.lit(seed + 1)).alias("h"))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("h").head(psi)
        X = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, d))
        rng = np.random.default_rng(seed * 1000003 + t)
        nodes = []  # (feature, split, left, right, size)

        def grow(idx, depth):
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, len(idx)])
            if depth >= max_depth or len(idx) <= 1:
                return me
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.where(hi > lo)[0]
            if len(cand) == 0:
                return me
            f = int(rng.choice(cand))
            s = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < s]
            right = idx[sub[:, f] >= s]
            nodes[me][0], nodes[me][1] = f, s
            nodes[me][2] = grow(left, depth + 1)
            nodes[me][3] = grow(right, depth + 1)
            return me

        grow(np.arange(len(X)), 0)
        a = np.array(nodes, dtype=float) if nodes else np.zeros((0, 5))
        return pd.DataFrame({"tree": [t], "feat": [a[:, 0].astype(int).tolist()], "split": [a[:, 1].tolist()],
                             "left": [a[:, 2].astype(int).tolist()], "right": [a[:, 3].astype(int).tolist()],
                             "size": [a[:, 4].astype(int).tolist()]})

    trees = samp.groupBy("tree").applyInPandas(
        build, "tree int, feat array<int>, split array<double>, left array<int>, right array<int>, size array<int>")
    forest = [(r["feat"], r["split"], r["left"], r["right"], r["size"]) for r in trees.collect()]
    bc = df.sparkSession.sparkContext.broadcast(forest)
    cn = _c(psi)

    @F.pandas_udf(T.DoubleType())
    def score(v: pd.Series) -> pd.Series:
        X = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, d))
        depth = np.zeros(len(X))
        for feat, split, left, right, size in bc.value:
            node = np.zeros(len(X), dtype=int)
            h = np.zeros(len(X))
            feat_a, split_a = np.array(feat), np.array(split)
            left_a, right_a, ends = np.array(left), np.array(right), np.array([_c(s) for s in size])
            idx = np.arange(len(X))
            while len(idx):  # the rows not yet at a leaf
                idx = idx[feat_a[node[idx]] >= 0]
                at = node[idx]
                node[idx] = np.where(X[idx, feat_a[at]] < split_a[at], left_a[at], right_a[at])
                h[idx] += 1
            depth += h + ends[node]
        e = depth / max(len(bc.value), 1)
        return pd.Series(np.power(2.0, -e / cn) if cn > 0 else np.zeros(len(X)))

    # stored: the cut of the scores reads them several times
    return cut_lineage(df.select(F.col(id_col), score(x).alias("score")))


def ocsvm(df: DataFrame, features: list[str], id_col: str = "id", nu: float = 0.5, gamma: float | None = None,
          n_components: int = 64, steps: int = 30, lr: float = 0.5, seed: int = 42) -> DataFrame:
    """Approximate one-class SVM: random Fourier features z(x), then minimise
    1/2|w|^2 + 1/(nu n) sum max(0, rho - w.z) - rho by subgradient steps (one aggregate each).
    Score = rho - w.z(x) (higher = more outlying). Documented as approximate."""
    d = len(features)
    g = gram(df, features)
    mu, cov = mean_cov(g)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    gm = gamma if gamma is not None else 1.0 / d
    rng = np.random.default_rng(seed)
    W = rng.normal(0, math.sqrt(2 * gm), size=(n_components, d))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    xs = [(F.col(c).cast("double") - F.lit(float(mu[i]))) / F.lit(float(sd[i])) for i, c in enumerate(features)]
    scale = math.sqrt(2.0 / n_components)
    z = [F.lit(scale) * F.cos(sum(F.lit(float(W[j, i])) * xs[i] for i in range(d)) + F.lit(float(b[j])))
         for j in range(n_components)]
    # stored rows hold n_components numbers, many times the input's size: dealt to tasks by their number
    zdf = _spread(df.select(id_col, *[c for c in dict.fromkeys(features) if c != id_col]), int(g["n"]))
    zdf = zdf.select(F.col(id_col), F.array(*z).alias("z")).cache()
    n = zdf.count()
    w = np.zeros(n_components)
    rho = 0.0
    for t in range(steps):
        wl = F.array(*[F.lit(float(v)) for v in w])
        dot = F.aggregate(F.zip_with("z", wl, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
        viol = zdf.where(dot < F.lit(rho))
        r = viol.agg(F.count(F.lit(1)).alias("m"),
                     *[F.sum(F.col("z")[j]).alias(f"s{j}") for j in range(n_components)]).first()
        m = r["m"]
        sz = np.array([r[f"s{j}"] or 0.0 for j in range(n_components)])
        gw = w - sz / (nu * n)
        grho = m / (nu * n) - 1.0
        step = lr / math.sqrt(t + 1)
        w = w - step * gw
        rho = rho - step * grho
    wl = F.array(*[F.lit(float(v)) for v in w])
    dot = F.aggregate(F.zip_with("z", wl, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    return zdf.select(F.col(id_col), (F.lit(rho) - dot).alias("score"))


DETECTORS = {"iforest": iforest, "pca": pca_score, "histogram": hbos, "mcd": mcd, "cluster": cluster_score,
             "svm": ocsvm}


def remove_outliers(df: DataFrame, features: list[str], id_col: str, threshold: float = 0.05,
                    method: str = "iforest") -> DataFrame:
    """Drop the ``threshold`` share of rows with the highest anomaly score (cut at an exact quantile)."""
    if method in DETECTORS:
        s = DETECTORS[method](df, features, id_col=id_col)
    else:
        from tabwright.operators import neighbors
        fn = {"knn": neighbors.knn_outlier, "lof": neighbors.lof, "abod": neighbors.abod, "cof": neighbors.cof}[method]
        v = df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("vec"))
        s = fn(v).withColumnRenamed("id", id_col)
    cut = quantile_dict(s, ["score"], [1.0 - threshold]).get(("score", 1.0 - threshold))
    gone = s.where(F.col("score") > F.lit(cut)).select(id_col)  # a row without a score is no outlier
    return df.join(gone, id_col, "left_anti")


def score_table(scores: DataFrame, contamination: float = 0.05, id_col: str = "id") -> DataFrame:
    """``(id, score, is_outlier)`` with the cut at the exact (1 - contamination) quantile."""
    cut = quantile_dict(scores, ["score"], [1.0 - contamination]).get(("score", 1.0 - contamination))
    return scores.withColumn("is_outlier", F.col("score") > F.lit(cut))
