"""Operators built on the exact kNN join: kNN models, distance-based outlier
scores (kNN, LOF, ABOD, COF) and the SMOTE family.

All of them consume the neighbour table ``(qid, nid, rank, dist)`` - at most
k rows per point - and join it back to per-point attributes, so every step is
an equi-join or a ``groupBy`` on ids; no group ever exceeds k (or k^2 for ABOD
/ COF pairs) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.knn import euclid, knn_join


def knn_predict(train: DataFrame, queries: DataFrame, label: str, k: int = 5, id_col: str = "id",
                vec_col: str = "vec", classification: bool = True, exclude_self: bool = False) -> DataFrame:
    """kNN model: majority vote (ties -> smallest label) or mean of the k neighbours' labels."""
    nb = knn_join(queries, train, k, id_col, vec_col, exclude_self=exclude_self)
    lab = train.select(F.col(id_col).alias("nid"), F.col(label).alias("__y"))
    j = nb.join(lab, "nid")
    if classification:
        votes = j.groupBy("qid", "__y").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("__y").alias("y"))).alias("m"))
        return best.select(F.col("qid").alias(id_col), F.col("m.y").alias("prediction"))
    return j.groupBy("qid").agg(F.avg(F.col("__y").cast("double")).alias("prediction")).withColumnRenamed("qid", id_col)


def knn_outlier(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Distance to the k-th nearest neighbour (larger = more outlying)."""
    nb = knn_join(df, None, k, id_col, vec_col)
    return nb.groupBy("qid").agg(F.max("dist").alias("score")).withColumnRenamed("qid", id_col)


def lof(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Local outlier factor over the k nearest neighbours (k-distance = distance to the k-th one)."""
    nb = knn_join(df, None, k, id_col, vec_col).cache()
    kd = nb.groupBy("qid").agg(F.max("dist").alias("kdist"))
    reach = (nb.join(kd.withColumnRenamed("qid", "nid").withColumnRenamed("kdist", "nkd"), "nid")
             .withColumn("reach", F.greatest("dist", "nkd")))
    lrd = reach.groupBy("qid").agg((1.0 / F.avg("reach")).alias("lrd"))
    r = (nb.join(lrd.withColumnRenamed("qid", "nid").withColumnRenamed("lrd", "nlrd"), "nid")
         .groupBy("qid").agg(F.avg("nlrd").alias("avg_nlrd"))
         .join(lrd, "qid"))
    return r.select(F.col("qid").alias(id_col), (F.col("avg_nlrd") / F.col("lrd")).alias("score"))


def abod(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Fast angle-based outlier score: -variance over neighbour pairs (a, b) of
    <a-p, b-p> / (|a-p|^2 |b-p|^2). Pairs are the k*(k-1)/2 within each neighbour set."""
    nb = knn_join(df, None, k, id_col, vec_col).select("qid", "nid", "rank")
    vec = df.select(F.col(id_col).alias("nid"), F.col(vec_col).cast("array<double>").alias("nv"))
    p = df.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("pv"))
    d = (nb.join(vec, "nid").join(p, "qid")
         .select("qid", "rank", F.zip_with("nv", "pv", lambda a, b: a - b).alias("u")))
    a = d.alias("a")
    b = d.alias("b")
    pairs = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.rank") < F.col("b.rank")))
    dot = F.aggregate(F.zip_with("a.u", "b.u", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.aggregate(F.transform("a.u", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    nbb = F.aggregate(F.transform("b.u", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    f = pairs.select(F.col("a.qid").alias("qid"), (dot / (na * nbb)).alias("f"))
    return f.groupBy("qid").agg((-F.var_pop("f")).alias("score")).withColumnRenamed("qid", id_col)


def cof(df: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """Connectivity-based outlier factor: average chaining distance of a point over that of its neighbours.

    The set-based nearest path inside each neighbourhood (k+1 points) runs in a
    pandas UDF per point; its input is bounded by k.
    """
    import numpy as np
    import pandas as pd

    nb = knn_join(df, None, k, id_col, vec_col).select("qid", "nid", "rank")
    vec = df.select(F.col(id_col).alias("nid"), F.col(vec_col).cast("array<double>").alias("nv"))
    me = df.select(F.col(id_col).alias("qid"), F.col(id_col).alias("nid"), F.lit(0).alias("rank"))
    g = me.unionByName(nb).join(vec, "nid")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = np.stack(pdf["nv"].to_numpy())
        n = len(x)
        if n < 2:
            return pd.DataFrame({"qid": [pdf["qid"].iloc[0]], "ac": [0.0]})
        dm = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
        inside = [0]
        costs = []
        rest = list(range(1, n))
        while rest:
            sub = dm[np.ix_(inside, rest)]
            j = int(np.argmin(sub.min(axis=0)))
            costs.append(float(sub[:, j].min()))
            inside.append(rest.pop(j))
        r = n - 1
        w = np.array([2.0 * (r - i) / (r * (r + 1)) for i in range(r)])
        return pd.DataFrame({"qid": [pdf["qid"].iloc[0]], "ac": [float((w * np.array(costs)).sum())]})

    ac = g.groupBy("qid").applyInPandas(chain, f"qid {df.schema[id_col].dataType.simpleString()}, ac double")
    nac = nb.join(ac.withColumnRenamed("qid", "nid").withColumnRenamed("ac", "nac"), "nid").groupBy("qid").agg(
        F.avg("nac").alias("mean_nac"))
    return ac.join(nac, "qid").select(F.col("qid").alias(id_col),
                                      F.when(F.col("mean_nac") > 0, F.col("ac") / F.col("mean_nac")).alias("score"))


# ---------------------------------------------------------------- SMOTE family

REPLICA_CHUNK = 10_000  # synthetic rows generated per task from one seed row


def _unit(*cols) -> F.Column:
    """Deterministic uniform [0,1) from the hash of the given columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def smote(df: DataFrame, target: str, features: list[str], id_col: str, k: int = 5, seed: int = 42,
          method: str = "smote") -> DataFrame:
    """Oversample every minority class up to the majority count with synthetic rows.

    ``method``: ``smote`` (all minority rows seed equally), ``adasyn`` (seeds in
    proportion to the share of other-class rows among each row's k neighbours in
    the whole table), ``borderline`` (only rows with k/2 <= other-class neighbours < k).
    A synthetic row is x + u (n - x) for a minority neighbour n of x, u from a hash.
    Returns the original rows plus the synthetic ones (``synthetic`` flag).
    """
    vec = F.array(*[F.col(c).cast("double") for c in features])
    base = df.select(F.col(id_col).alias("id"), F.col(target).alias("y"), vec.alias("vec"))
    counts = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(counts.values())
    out = df.select(*df.columns, F.lit(False).alias("synthetic"))
    for cls, n_c in sorted(counts.items(), key=lambda t: str(t[0])):
        need = top - n_c
        if need <= 0 or n_c < 2:
            continue
        minority = base.where(F.col("y") == F.lit(cls))
        nn = knn_join(minority, None, min(k, n_c - 1), "id", "vec")
        if method == "smote":
            weights = minority.select("id", F.lit(1.0).alias("w"))
        else:
            allnb = knn_join(minority, base, k, "id", "vec").join(
                base.select(F.col("id").alias("nid"), F.col("y").alias("ny")), "nid")
            other = allnb.groupBy("qid").agg(F.sum((F.col("ny") != F.lit(cls)).cast("double")).alias("o"))
            if method == "adasyn":
                weights = other.select(F.col("qid").alias("id"), (F.col("o") / k).alias("w"))
            elif method == "borderline":
                weights = other.select(F.col("qid").alias("id"),
                                       F.when((F.col("o") >= k / 2.0) & (F.col("o") < k), 1.0).otherwise(0.0).alias("w"))
            else:
                raise ValueError(f"unknown oversampling method {method!r}")
        tot = weights.agg(F.sum("w")).first()[0] or 0.0
        if tot <= 0:
            weights = minority.select("id", F.lit(1.0).alias("w"))
            tot = float(n_c)
        # replicas per seed row: floor of its share, plus one for the largest remainders (rank by hash tiebreak)
        share = weights.withColumn("exact", F.col("w") / F.lit(tot) * F.lit(need))
        share = share.withColumn("base", F.floor("exact").cast("int")).withColumn("rem", F.col("exact") - F.col("base"))
        left = need - (share.agg(F.sum("base")).first()[0] or 0)
        extra = select_top_remainders(share, left, seed)
        reps = share.join(extra, "id", "left").select(
            "id", (F.col("base") + F.coalesce(F.col("plus"), F.lit(0))).alias("m")).where(F.col("m") > 0)
        # a seed may need very many replicas (tiny minority, huge majority): split its replicas into chunks of
        # at most REPLICA_CHUNK and spread the chunks over tasks before generating the rows
        chunks = reps.select("id", "m", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / REPLICA_CHUNK)
                                                            .cast("int"))).alias("ch"))
        chunks = chunks.repartition("id", "ch")
        seeds = chunks.select("id", F.explode(F.sequence(F.col("ch") * REPLICA_CHUNK + 1,
                                                         F.least((F.col("ch") + 1) * REPLICA_CHUNK, F.col("m"))))
                              .alias("j"))
        kk = min(k, n_c - 1)
        pick = (seeds.withColumn("rank", (F.floor(_unit(F.col("id"), F.col("j"), F.lit(seed)) * kk) + 1).cast("int"))
                .join(nn.select(F.col("qid").alias("id"), "rank", "nid"), ["id", "rank"]))
        xv = minority.select("id", F.col("vec").alias("xv"))
        nv = minority.select(F.col("id").alias("nid"), F.col("vec").alias("nv"))
        syn = (pick.join(xv, "id").join(nv, "nid")
               .withColumn("u", _unit(F.col("id"), F.col("j"), F.lit(seed + 1)))
               .select(F.zip_with("xv", "nv", lambda a, b: a + F.col("u") * (b - a)).alias("v"), "id", "j"))
        cols = []
        for f in df.schema.fields:
            if f.name in features:
                cols.append(F.col("v")[features.index(f.name)].cast(f.dataType).alias(f.name))
            elif f.name == target:
                cols.append(F.lit(cls).cast(f.dataType).alias(f.name))
            elif f.name == id_col:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            else:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        out = out.unionByName(syn.select(*cols, F.lit(True).alias("synthetic")))
    return out


def select_top_remainders(share: DataFrame, left: int, seed: int) -> DataFrame:
    """``(id, plus=1)`` for the ``left`` rows with the largest remainders (ties by hash).

    A global ordering of seed rows is needed here; it is done with the exact
    hash-prefix cutoff of ``functions.ranks`` rather than a single-partition sort.
    """
    from tabwright.functions.ranks import select_first

    if left <= 0:
        return share.select("id", F.lit(1).alias("plus")).limit(0)
    key = F.concat(F.format_string("%020.0f", (1.0 - F.col("rem")) * F.lit(1e15)),
                   F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))))
    sel = select_first(share.withColumn("__k", key), F.col("__k"), ["id"], {(): int(left)}, [])
    return sel.select("id", F.lit(1).alias("plus"))

