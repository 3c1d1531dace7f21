"""Experiment: set-up, cross-validated model comparison, analysis, evaluation, persistence.

Set-up (all fitted on the training rows only, never on the hold-out):
label indexing -> exact md5 train/hold-out split (stratified for classification)
-> one-hot (<= ``max_onehot`` values) or frequency encoding of string columns
-> imputation / scaling constants -> optional outlier removal, imbalance fix and
feature selection on the training rows. The design table (double feature
columns + ``__label`` + ``__fold``) is written once through a reliable
checkpoint, so every fold fit re-reads it instead of recomputing the
preparation, and executor loss cannot force a recompute from the sources.

``compare_models`` fits every (model, fold) pair as its own Spark jobs,
``parallelism`` of them submitted concurrently from driver threads, collects the
one-row metric tables and ranks the models.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.config import PrepConfig, RunConfig, from_json, to_json
from tabwright.functions.columns import columns_of, normalize_nan
from tabwright.models import store
from tabwright.models.base import Fitted, load_fitted
from tabwright.models.catalog import get_model, models as model_table
from tabwright.operators import metrics as M
from tabwright.operators import prep as P
from tabwright.operators import sample as S
from tabwright.session import cut_lineage

FIT_ROWS = 100_000  # rows that are worth a task of a model fit
TASK_ROWS = 500_000  # rows of such a task, about, once every core has one
MAX_ONEHOT = 25  # fixed value: string columns with at most this many values are one-hot encoded


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """The about ``n`` rows dealt evenly to tasks: a fit's scans cost far more than reading, but a small file is one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(-(-n // FIT_ROWS), max(2 * cores, -(-n // TASK_ROWS)))
    return df.repartition(parts) if parts > 1 else df


@dataclass
class Experiment:
    df: DataFrame
    target: str | None
    key: list[str]
    run: RunConfig = field(default_factory=RunConfig)
    prep: PrepConfig = field(default_factory=PrepConfig)
    max_onehot: int = MAX_ONEHOT
    parallelism: int = 4

    # filled by setup()
    features: list[str] = field(default_factory=list)
    classes: list = field(default_factory=list)
    design: DataFrame | None = None
    holdout: DataFrame | None = None
    encoders: dict = field(default_factory=dict)
    imputer: object = None
    scaler: object = None
    fitted: dict = field(default_factory=dict)

    @property
    def problem(self) -> str:
        return self.run.problem

    # ------------------------------------------------------------ set-up
    def setup(self) -> Experiment:
        df = normalize_nan(self.df)
        sup = self.problem in ("classification", "regression")
        if self.problem not in ("classification", "regression", "clustering", "anomaly", "nlp"):
            raise ValueError(f"Unsupported problem type: {self.problem}")
        if not sup and self.target in df.columns:
            df = df.drop(self.target)
        if sup:
            if self.target not in df.columns:
                raise ValueError(f"target {self.target!r} not in the table")
            df = df.where(F.col(self.target).isNotNull())
            if self.problem == "classification":
                # the label index is collected by the indexer: refuse targets with unbounded distinct values
                if S.n_classes_capped(df, self.target, 10_000) > 10_000:
                    raise ValueError(f"target {self.target!r} has more than 10000 classes")
                idx = StringIndexer(inputCol="__ys", outputCol="__label", stringOrderType="alphabetAsc")
                df = df.withColumn("__ys", F.col(self.target).cast("string"))
                sim = idx.fit(df)
                self.classes = list(sim.labels)
                df = sim.transform(df).drop("__ys")
            else:
                df = df.withColumn("__label", F.col(self.target).cast("double"))
        strat = "__label" if self.problem == "classification" else None
        n_rows = df.count()
        df = S.train_test_split(df, self.key, self.run.train_size, target=strat, seed=self.run.seed)
        train = df.where("is_train")
        hold = df.where(~F.col("is_train"))
        skip = set(self.key) | {self.target, "__label", "is_train"}
        num = [c for c in columns_of(df, "numeric") if c not in skip]
        cats = [c for c in columns_of(df, "categorical") if c not in skip]
        # encodings learnt on training rows; value lists are bounded by max_onehot
        for c in cats:
            vals = (train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
                    .orderBy(F.desc("n"), c).limit(self.max_onehot + 1).collect())
            if len(vals) <= self.max_onehot:
                self.encoders[c] = ("onehot", [r[c] for r in vals])
            else:
                self.encoders[c] = ("freq", None)
        freq_tables = {}
        for c, (kind, _) in self.encoders.items():
            if kind == "freq":
                n = train.count()
                freq_tables[c] = train.groupBy(c).agg((F.count(F.lit(1)) / F.lit(float(n))).alias(f"__fq_{c}"))
        base = train.select(*self.key, "__label" if sup else F.lit(None).cast("double").alias("__label"), *num, *cats)
        if self.prep.imputation in ("mean", "median", "mode"):
            self.imputer = P.fit_imputer(base.drop(*self.key, "__label"), self.prep.imputation)
        elif self.prep.imputation:
            from tabwright.operators.impute_model import fit_model_imputer
            self.imputer = fit_model_imputer(base, self.prep.imputation, num, cats, self.key)
        self._freq = freq_tables
        enc = self._encode(base)
        if self.prep.normalization:
            self.scaler = P.fit_scaler(enc.select(*self.features), self.prep.normalization)
            enc = self.scaler.transform(enc)
        enc = self._post_train(enc)
        enc = S.kfold(enc, self.key, self.run.folds, seed=self.run.seed, col="__fold")
        self.design = cut_lineage(_dealt(enc, n_rows))
        self.holdout = hold
        return self

    def _encode(self, df: DataFrame) -> DataFrame:
        """Apply imputation and encodings; returns key + __label + double feature columns."""
        if self.imputer is not None:
            df = self.imputer.transform(df)
        cols, feats = [], []
        for f in df.schema.fields:
            c = f.name
            if c in self.key or c == "__label":
                continue
            if c in self.encoders:
                kind, vals = self.encoders[c]
                if kind == "onehot":
                    for i, v in enumerate(vals):
                        name = f"{c}__{i}"
                        cols.append(F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(name))
                        feats.append(name)
                else:
                    # one row per distinct value: a shuffle join, not a broadcast (its size grows with the data)
                    df = df.join(self._freq[c], c, "left")
                    cols.append(F.coalesce(F.col(f"__fq_{c}"), F.lit(0.0)).alias(f"{c}__freq"))
                    feats.append(f"{c}__freq")
            elif f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal"):
                cols.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if self.imputer is None
                            else F.col(c).cast("double").alias(c))
                feats.append(c)
        if not self.features:
            self.features = feats
        return df.select(*self.key, "__label", *cols)

    def _post_train(self, enc: DataFrame) -> DataFrame:
        pc = self.prep
        if pc.remove_outliers and self.features:
            from tabwright.operators.anomaly import remove_outliers
            enc = remove_outliers(enc.withColumn("__rid", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in self.key]))),
                                  self.features, "__rid", pc.outlier_threshold).drop("__rid")
        if pc.sample_pct < 100:
            strat = "__label" if self.problem == "classification" else None
            enc = (S.stratified_sample(enc, strat, pc.sample_pct, self.key, seed=42) if strat
                   else S.random_sample(enc, pc.sample_pct, self.key, seed=42))
        if pc.feature_selection and self.problem in ("classification", "regression"):
            from tabwright.operators.select_model import select_features
            k = max(1, int(round(len(self.features) * pc.n_features)))
            self.features = select_features(enc, self.features, "__label", k, pc.feature_selection,
                                            self.problem == "classification")
            enc = enc.select(*self.key, "__label", *self.features)
        return enc

    def _balance(self, tr: DataFrame) -> DataFrame:
        """Imbalance fix applied to training rows only (inside each fold), never to validation rows."""
        pc = self.prep
        if not pc.imbalance or self.problem != "classification":
            return tr
        if pc.imbalance == "randomunder":
            return S.undersample(tr, "__label", self.key)
        from tabwright.operators.neighbors import smote
        method = {"smote": "smote", "adasyn": "adasyn", "bordersmote": "borderline"}[pc.imbalance]
        rid = tr.withColumn("__rid", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in self.key])))
        return smote(rid, "__label", self.features, "__rid", method=method).drop("__rid", "synthetic")

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply the fitted preparation to new rows (also works on a streaming DataFrame)."""
        df = normalize_nan(df)
        if "__label" not in df.columns:
            if self.problem == "classification" and self.target in df.columns:
                m = F.create_map(*[x for i, c in enumerate(self.classes) for x in (F.lit(c), F.lit(float(i)))])
                df = df.withColumn("__label", m[F.col(self.target).cast("string")])
            elif self.target in df.columns:
                df = df.withColumn("__label", F.col(self.target).cast("double"))
            else:
                df = df.withColumn("__label", F.lit(None).cast("double"))
        src_cols = [c for c in df.columns if c in self.key or c == "__label" or c in self.encoders
                    or c in (self.imputer.fills if self.imputer else {}) or c in self.features]
        enc = self._encode(df.select(*src_cols))
        if self.scaler is not None:
            enc = self.scaler.transform(enc)
        return enc.select(*self.key, "__label", *self.features)

    # ------------------------------------------------------------ models
    def _metrics(self, pred: DataFrame) -> dict:
        if self.problem == "classification":
            m = M.classification_metrics(pred, "__label", "prediction").first().asDict()
            m["auc"] = None
            if "probability" in pred.columns:
                k = len(self.classes)
                if k == 2:
                    a = M.auc(pred.withColumn("is_pos", F.col("__label") == 1.0), "score").first()
                    m["auc"] = a["auc"]
                else:
                    pc = pred.select("__label", *[F.col("probability")[i].alias(f"p{i}") for i in range(k)])
                    m["auc"] = M.auc_ovr(pc.withColumn("__ls", F.col("__label").cast("int").cast("string")), "__ls",
                                         {str(i): f"p{i}" for i in range(k)}).first()["auc"]
            return m
        return M.regression_metrics(pred, "__label", "prediction").first().asDict()

    def _fold_run(self, model_id: str, fold: int, params: dict) -> dict:
        m = get_model(self.problem, model_id).with_params(**params)
        tr = self._balance(self.design.where(F.col("__fold") != fold))
        te = self.design.where(F.col("__fold") == fold)
        t0 = time.time()
        f = m.fit(tr, self.features, "__label")
        secs = time.time() - t0
        res = self._metrics(f.transform(te))
        res.update({"model": model_id, "fold": fold, "fit_seconds": secs})
        return res

    GRAM_IDS = ("lr", "ridge", "lasso", "en", "lar", "llar", "omp", "br", "ard")

    def _gram_cv(self, ids: list[str]) -> list[dict]:
        """k-fold CV of Gram-family regressors in two scans: per-fold Grams in one grouped aggregate
        (training Gram = total - fold), then all models x folds scored by one projection + aggregate."""
        import numpy as np
        from tabwright.functions.linalg import linear
        from tabwright.models.linear import GramRegressor
        t0 = time.time()
        feats = self.features
        d = len(feats)
        x = [F.col(c).cast("double") for c in feats]
        y = F.col("__label").cast("double")
        aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy")]
        aggs += [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * y).alias(f"xy{i}") for i in range(d)]
        aggs += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
        per = {r["__fold"]: r for r in self.design.groupBy("__fold").agg(*aggs).collect()}  # one row per fold

        def g_of(rows):
            n = float(sum(r["n"] for r in rows))
            sx = np.array([sum(r[f"s{i}"] or 0.0 for r in rows) for i in range(d)])
            xx = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    xx[i, j] = xx[j, i] = sum(r[f"p{i}_{j}"] or 0.0 for r in rows)
            return {"n": n, "sx": sx, "xx": xx, "xy": np.array([sum(r[f"xy{i}"] or 0.0 for r in rows) for i in range(d)]),
                    "sy": sum(r["sy"] or 0.0 for r in rows), "yy": sum(r["yy"] or 0.0 for r in rows)}

        folds = sorted(per)
        preds = {}
        for mid in ids:
            e = None
            for f in folds:
                fit = GramRegressor(mid, "regression", "").fit_from_gram(g_of([per[o] for o in folds if o != f]), feats)
                p = linear(feats, fit.coef, fit.intercept)
                e = F.when(F.col("__fold") == f, p) if e is None else e.when(F.col("__fold") == f, p)
            preds[mid] = e
        from tabwright.operators.metrics import MAPE_EPS
        maggs = [F.var_pop(y).alias("vy")]
        for i, mid in enumerate(ids):
            p = preds[mid]
            err = y - p
            maggs += [F.avg(F.abs(err)).alias(f"mae{i}"), F.avg(err * err).alias(f"mse{i}"),
                      F.avg(F.pow(F.log1p(p) - F.log1p(y), 2)).alias(f"msle{i}"),
                      F.sum(((y < 0) | (p < 0)).cast("int")).alias(f"neg{i}"),
                      F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(MAPE_EPS))).alias(f"mape{i}")]
        res = self.design.groupBy("__fold").agg(*maggs).collect()
        secs = (time.time() - t0) / max(len(ids), 1)
        out = []
        for r in res:
            for i, mid in enumerate(ids):
                mse = r[f"mse{i}"]
                out.append({"model": mid, "fold": r["__fold"], "mae": r[f"mae{i}"], "mse": mse,
                            "rmse": None if mse is None else mse ** 0.5,
                            "r2": (1 - mse / r["vy"]) if r["vy"] else None,
                            "rmsle": (r[f"msle{i}"] ** 0.5) if r[f"neg{i}"] == 0 and r[f"msle{i}"] is not None else None,
                            "mape": r[f"mape{i}"], "fit_seconds": secs / max(len(folds), 1)})
        return out

    def cross_validate(self, model_id: str, params: dict | None = None, folds: int | None = None) -> list[dict]:
        ks = range(folds or self.run.folds)
        with ThreadPoolExecutor(self.parallelism) as ex:
            return list(ex.map(lambda f: self._fold_run(model_id, f, params or {}), ks))

    def compare_models(self, include: list[str] | None = None, sort: str | None = None, n_select: int = 1,
                       params: dict | None = None) -> DataFrame:
        """Leaderboard ``(model, title, <metrics>, fit_seconds, error)`` best first; failed models keep a row."""
        cat = model_table(self.problem)
        ids = list(include) if include else list(cat)
        sort = (sort or self.run.sort_metric or ("accuracy" if self.problem == "classification" else "mae")).lower()
        jobs = [(mid, f) for mid in ids for f in range(self.run.folds)]
        rows: list[dict] = []

        def run(job):
            mid, f = job
            try:
                return self._fold_run(mid, f, (params or {}).get(mid, {}))
            except Exception as e:  # noqa: BLE001 - a failing model becomes a row with its error
                return {"model": mid, "fold": f, "error": f"{type(e).__name__}: {str(e)[:200]}"}

        fast = [m for m in ids if self.problem == "regression" and m in self.GRAM_IDS and not (params or {}).get(m)]
        rows = []
        if fast:
            try:
                rows = self._gram_cv(fast)
            except Exception as e:  # noqa: BLE001 - fall back to one fit per fold
                rows = []
                fast = []
                _ = e
        jobs = [j for j in jobs if j[0] not in fast]
        with ThreadPoolExecutor(self.parallelism) as ex:
            rows += list(ex.map(run, jobs))
        metric_names = list(M.CLASSIFICATION_METRICS if self.problem == "classification" else M.REGRESSION_METRICS)
        board = []
        for mid in ids:
            rs = [r for r in rows if r["model"] == mid]
            err = next((r["error"] for r in rs if "error" in r), None)
            ok = [r for r in rs if "error" not in r]
            rec = {"model": mid, "title": cat[mid].title if mid in cat else mid}
            for m in metric_names:
                vals = [r.get(m) for r in ok if r.get(m) is not None]
                rec[m] = float(sum(vals) / len(vals)) if vals else None
            rec["fit_seconds"] = float(sum(r.get("fit_seconds", 0.0) for r in ok))
            rec["error"] = err
            board.append(rec)
        asc = sort in M.ASCENDING
        board.sort(key=lambda r: (r.get(sort) is None, (r.get(sort) or 0.0) * (1 if asc else -1), r["model"]))
        self.leaderboard_rows = board
        self.best = [r["model"] for r in board if r["error"] is None][:n_select]
        schema = ("model string, title string, " + ", ".join(f"{m} double" for m in metric_names)
                  + ", fit_seconds double, error string")
        return self.df.sparkSession.createDataFrame([tuple(r[c] for c in ["model", "title", *metric_names,
                                                                          "fit_seconds", "error"]) for r in board],
                                                    schema)

    def create_model(self, model_id: str, **params) -> Fitted:
        f = get_model(self.problem, model_id).with_params(**params).fit(self._balance(self.design), self.features,
                                                                         "__label")
        self.fitted[model_id] = f
        return f

    def predict(self, fitted: Fitted, df: DataFrame | None = None) -> DataFrame:
        data = self.transform(df if df is not None else self.holdout)
        return fitted.transform(data)

    def evaluate(self, fitted: Fitted, df: DataFrame | None = None) -> DataFrame:
        """Metrics on the hold-out rows (or on ``df``) as a one-row table."""
        res = self._metrics(self.predict(fitted, df))
        names = list(M.CLASSIFICATION_METRICS if self.problem == "classification" else M.REGRESSION_METRICS)
        return self.df.sparkSession.createDataFrame([tuple(res.get(m) for m in names)],
                                                    ", ".join(f"{m} double" for m in names))

    def importance(self, fitted: Fitted) -> DataFrame:
        imp = fitted.importances() or []
        return self.df.sparkSession.createDataFrame(imp, "feature string, importance double")

    def analyze(self, model_id: str) -> dict[str, DataFrame]:
        """Tables behind the analysis charts for the named model (fitted on demand)."""
        f = self.fitted.get(model_id) or self.create_model(model_id)
        pred = self.predict(f)
        out = {"importance": self.importance(f), "predictions": pred}
        if self.problem == "classification":
            out["confusion"] = M.confusion(pred, "__label", "prediction")
            out["class_report"] = M.class_report(pred, "__label", "prediction")
            if len(self.classes) == 2 and "score" in pred.columns:
                out["roc"] = M.roc_curve(pred.withColumn("is_pos", F.col("__label") == 1.0), "score")
        else:
            out["residuals"] = M.residuals(pred, "__label", "prediction")
            out["residual_stats"] = M.residual_stats(pred, "__label", "prediction")
        return out

    # ------------------------------------------------------------ persistence
    def save_model(self, fitted: Fitted, path: str, results: DataFrame | None = None) -> str:
        """Model, fitted preparation, run configuration (secrets dropped) and optional results table under one folder."""
        spark, path = self.df.sparkSession, path.rstrip("/")
        fitted.save(f"{path}/model")
        store.save(spark, {"imputer": self.imputer, "scaler": self.scaler, "encoders": self.encoders,
                           "freq": self._freq, "features": self.features, "classes": self.classes},
                   f"{path}/preparation")
        meta = {"run": json.loads(to_json(self.run)), "prep": json.loads(to_json(self.prep)),
                "features": self.features, "classes": self.classes, "target": self.target, "key": self.key}
        self.df.sparkSession.createDataFrame([(json.dumps(meta),)], "config string").coalesce(1).write.mode(
            "overwrite").json(f"{path}/config")
        if results is not None:
            results.write.mode("overwrite").parquet(f"{path}/results")
        return path


def load_model(spark, path: str):
    """Returns (fitted model, config dict, results DataFrame or None)."""
    path = path.rstrip("/")
    f = load_fitted(f"{path}/model")
    cfg = json.loads(spark.read.json(f"{path}/config").first()["config"])
    res = spark.read.parquet(f"{path}/results") if store.exists(spark, f"{path}/results") else None
    return f, cfg, res


def load_experiment(spark, path: str) -> tuple[Experiment, Fitted]:
    """The saved preparation and model: ``ex.predict(model, raw_rows)`` scores rows as they were before preparation."""
    model, cfg, _ = load_model(spark, path)
    kept = store.load(spark, f"{path.rstrip('/')}/preparation")
    ex = Experiment(None, cfg["target"], cfg["key"], from_json(RunConfig, json.dumps(cfg["run"])),
                    from_json(PrepConfig, json.dumps(cfg["prep"])), features=kept["features"], classes=kept["classes"],
                    encoders=kept["encoders"], imputer=kept["imputer"], scaler=kept["scaler"])
    ex._freq = kept["freq"]
    return ex, model


def compare_unsupervised(df: DataFrame, features: list[str], id_col: str, problem: str,
                         include: list[str] | None = None, contamination: float = 0.05) -> DataFrame:
    """Clustering: (model, n_clusters, noise_rows, silhouette, fit_seconds, error);
    anomaly: (model, score_p50, score_p95, outliers, fit_seconds, error). A failing model keeps a row."""
    from tabwright.functions.quantiles import quantile_dict
    spark = df.sparkSession
    rows = []
    if problem == "clustering":
        from tabwright.models.cluster import CLUSTERERS, silhouette
        for mid in include or list(CLUSTERERS):
            t0 = time.time()
            try:
                a = cut_lineage(CLUSTERERS[mid](df, features, id_col))
                st = a.agg(F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"),
                           F.sum((F.col("cluster") < 0).cast("int")).alias("noise")).first()
                rows.append((mid, int(st["k"]), int(st["noise"] or 0), silhouette(a, df, features, id_col),
                             time.time() - t0, None))
            except Exception as e:  # noqa: BLE001
                rows.append((mid, None, None, None, time.time() - t0, f"{type(e).__name__}: {str(e)[:200]}"))
        return spark.createDataFrame(rows, "model string, n_clusters int, noise_rows int, silhouette double, "
                                           "fit_seconds double, error string")
    if problem == "anomaly":
        from tabwright.operators import anomaly, neighbors
        dets = dict(anomaly.DETECTORS)
        vec_based = {"knn": neighbors.knn_outlier, "lof": neighbors.lof, "abod": neighbors.abod, "cof": neighbors.cof}
        for mid in include or (list(dets) + list(vec_based)):
            t0 = time.time()
            try:
                if mid in dets:
                    s = dets[mid](df, features, id_col=id_col)
                else:
                    v = df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("vec"))
                    s = vec_based[mid](v).withColumnRenamed("id", id_col)
                s = cut_lineage(s)
                q = quantile_dict(s, ["score"], [0.5, 0.95, 1 - contamination])
                n_out = s.where(F.col("score") > F.lit(q[("score", 1 - contamination)])).count()
                rows.append((mid, q[("score", 0.5)], q[("score", 0.95)], n_out, time.time() - t0, None))
            except Exception as e:  # noqa: BLE001
                rows.append((mid, None, None, None, time.time() - t0, f"{type(e).__name__}: {str(e)[:200]}"))
        return spark.createDataFrame(rows, "model string, score_p50 double, score_p95 double, outliers long, "
                                           "fit_seconds double, error string")
    raise ValueError(f"Unsupported problem type: {problem}")


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First rows for display; with ``order_by`` the rows are deterministic (top-k by that key)."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)
