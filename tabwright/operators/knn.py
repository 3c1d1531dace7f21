"""Exact k-nearest-neighbour join (Euclidean) without a cross join.

Plan
----
1. ``m`` pivots: the rows with the smallest md5 of their id (a bounded
   ``orderBy().limit(m)``). Every point gets its distances to the pivots - a
   narrow projection against a broadcast of ``m`` vectors. By the triangle
   inequality ``max_j |d_j(q) - d_j(x)| <= |q - x|``.
2. The reference side is cut into ``B`` buckets of similar row counts by
   approximate quantiles of the first pivot distance (``B`` grows with the
   data so buckets hold about ``bucket_rows`` rows), a bucket into strips of the
   second pivot distance, and a strip by hash where it still holds more than
   ``BLOCK_ROWS`` rows, so that points at one pivot distance make no large
   block. The block index holds the range of every pivot distance in a block; it
   is a row for about ``STRIP_ROWS`` rows and broadcast, so that looking up blocks
   shuffles no vectors.
3. Round 1 is an equi-join on bucket and strip: each query meets the blocks at
   its own place and beside it - linear work, no cross join. The k best
   candidates per query give a radius ``r``.
4. Round 2 pairs a query with every other block whose box over all pivot
   distances comes within ``r`` (found by bucket, then by the index), keeping
   only candidates with ``dist <= r``, and the two rounds are ranked together.
   Every point not compared is farther than ``r``: the result is exact.
5. In many dimensions boxes leave out little, and a copy of each query for each
   block would be a table of N^2 / ``STRIP_ROWS`` vectors. Where few large blocks
   take fewer copies, round 2 compares all pairs of large blocks instead: still
   all distances, but a vector is copied only once per large block.

Distances are computed per (bucket, query chunk) block in numpy through
``cogroup().applyInPandas`` - bounded blocks, vectorised arithmetic - and only
the k best candidates per query and block leave a block. Top-k per query is
then ``row_number`` over at most k rows per paired bucket.
Ties in distance are broken by the neighbour id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import key_text
from tabwright.session import cut_lineage


def vector_of(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def sq_dist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def _with_pivots(df: DataFrame, pivots: list[list[float]]) -> DataFrame:
    dists = [euclid(F.col("__v"), F.array(*[F.lit(float(x)) for x in p])) for p in pivots]
    return df.withColumn("__pd", F.array(*dists))


COARSE = 1024  # coarse quantile ranges of the first pivot distance (bounds the inlined literals)


def _bucketizer(r: DataFrame, col: str, bucket_rows: int, coarse: int = COARSE):
    """Monotone bucket function with about ``bucket_rows`` reference rows per bucket.

    Level 1: ``coarse`` ranges cut at approximate quantiles (a mergeable sketch).
    Level 2: each range split into equal-width sub-buckets, as many as its row
    count / ``bucket_rows``. Only per-range constants (at most ``coarse`` of
    each) reach the driver and the expressions - never a list that grows with N.
    """
    n = r.count()
    coarse = max(1, min(coarse, n // max(bucket_rows, 1)))
    cuts = [i / coarse for i in range(1, coarse)]
    agg = r.agg(F.percentile_approx(col, cuts or [0.5], 10 * max(coarse, 1000)).alias("b"), F.min(col).alias("lo"),
                F.max(col).alias("hi")).first()
    if not cuts:
        agg = {"b": [], "lo": agg["lo"], "hi": agg["hi"]}
    if agg["lo"] is None:
        return (lambda c: F.lit(0)), 1
    bounds = sorted(set(float(x) for x in (agg["b"] or [])))
    blit = F.array(*[F.lit(b) for b in bounds]).cast("array<double>") if bounds else F.array().cast("array<double>")

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])

    def coarse_of(c: Column) -> Column:
        """How many bounds lie below ``c``, by halving."""
        if not bounds:
            return F.lit(0)
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(blit, at + step - 1) < c, at + step).otherwise(at))

    counts = {x["c"]: x["n"] for x in r.groupBy(coarse_of(F.col(col)).alias("c")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most `coarse` rows
    edges = [float(agg["lo"])] + bounds + [float(agg["hi"])]
    los, widths, subs, offs = [], [], [], []
    acc = 0
    for i in range(len(bounds) + 1):
        sub = max(1, -(-counts.get(i, 0) // bucket_rows))
        los.append(edges[i])
        widths.append(max(edges[i + 1] - edges[i], 0.0))
        subs.append(sub)
        offs.append(acc)
        acc += sub
    L = F.array(*[F.lit(x) for x in los])
    W = F.array(*[F.lit(x) for x in widths])
    S = F.array(*[F.lit(x) for x in subs])
    O = F.array(*[F.lit(x) for x in offs])

    def bucket_of(c: Column) -> Column:
        def placed(x: Column, ci: Column) -> Column:
            w = F.element_at(W, ci)
            s = F.element_at(S, ci)
            frac = F.when(w > 0, (x - F.element_at(L, ci)) / w).otherwise(F.lit(0.0))
            sub = F.least(F.greatest(F.floor(frac * s), F.lit(0)), s - 1)
            return (F.element_at(O, ci) + sub).cast("int")

        # arrays of one element: the value and its range are computed once, not wherever they are named
        def ranged(x: Column) -> Column:
            return F.get(F.transform(F.array(coarse_of(x) + 1), lambda ci: placed(x, ci)), F.lit(0))
        return F.get(F.transform(F.array(c), ranged), F.lit(0))

    return bucket_of, acc


CHUNK = 4096  # query rows per (bucket, chunk) block: bounds every cogroup group, and the block is copied for each
CELLS = 1 << 21  # distances held at once


def _nearest(qp, rp, k: int, exclude_self: bool, radius: bool):
    """k best (qid, nid, dist) of the queries (qid, __v[, __rad]) among the reference rows (nid, __rv).

    One matrix product gives squared distances that are off by less than ``slack``; what may be among the k best by
    them (and within the radius) is measured exactly, coordinate by coordinate."""
    import numpy as np
    import pandas as pd

    out = []
    if len(qp) and len(rp):
        nids = rp["nid"].to_numpy()
        order_n = np.argsort(nids, kind="stable")  # ties in distance -> smaller neighbour id first
        R, nids = np.stack(rp["__rv"].to_numpy()).astype(float)[order_n], nids[order_n]
        qids_all, Q_all = qp["qid"].to_numpy(), np.stack(qp["__v"].to_numpy()).astype(float)
        rad_all = qp["__rad"].to_numpy(float) if radius else np.full(len(qp), np.inf)
        d = R.shape[1]
        with np.errstate(all="ignore"):
            Rc, Qc_all = R - R.mean(axis=0), Q_all - R.mean(axis=0)
            rn, qn_all = (Rc * Rc).sum(axis=1), (Qc_all * Qc_all).sum(axis=1)
        plain = not (np.isfinite(rn).all() and np.isfinite(qn_all).all())  # gaps, or squares that overflow
        step, kk = max(1, CELLS // len(R)), k + 1 if exclude_self else k
        for s in range(0, len(Q_all), step):
            Q, qids, rad = Q_all[s:s + step], qids_all[s:s + step], rad_all[s:s + step]
            if plain:
                D = np.zeros((len(Q), len(R)))
                for j in range(d):
                    D += (Q[:, j, None] - R[None, :, j]) ** 2
                near = np.isfinite(D)
            else:
                qn = qn_all[s:s + step]
                D = Qc_all[s:s + step] @ Rc.T
                D *= -2.0
                D += rn
                slack = 8 * (d + 4) * np.finfo(float).eps * (qn + rn.max())
                most = rad * rad * (1 + EDGE) - qn + slack
                open_ = np.flatnonzero(~np.isfinite(rad))
                if len(open_):
                    most[open_] = (np.partition(D[open_], kk - 1, axis=1)[:, kk - 1] + 2 * slack[open_]
                                   if kk < len(R) else np.inf)
                near = D <= most[:, None]
            rows, cols = np.nonzero(near)
            if exclude_self:
                other = qids[rows] != nids[cols]
                rows, cols = rows[other], cols[other]
            dist = np.zeros(len(rows))
            for j in range(d):  # by coordinate: no table of differences
                dist += (Q[rows, j] - R[cols, j]) ** 2
            dist = np.sqrt(dist)
            ok = np.isfinite(dist) & (dist <= rad[rows])
            rows, cols, dist = rows[ok], cols[ok], dist[ok]
            at = np.lexsort((cols, dist, rows))
            rows, cols, dist = rows[at], cols[at], dist[at]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append((qids[rows[best]], nids[cols[best]], dist[best]))
    q, n, dist = (np.concatenate([o[i] for o in out]) if out else [] for i in range(3))
    return pd.DataFrame({"qid": pd.Series(list(q), dtype=object), "nid": pd.Series(list(n), dtype=object),
                         "dist": np.asarray(dist, dtype=float)})


def _block_topk(qrows: DataFrame, rrows: DataFrame, k: int, exclude_self: bool, id_types: tuple[str, str],
                radius: bool = False) -> DataFrame:
    """k best (qid, nid, dist) per query inside each bucket it is paired with.

    ``qrows``: (qid, __v, __b[, __rad]) - one row per (query, bucket) pairing;
    ``rrows``: (nid, __rv, __b). Queries of a bucket are split into chunks of at
    most ``CHUNK`` rows (the bucket's reference rows are repeated per chunk), and
    each (bucket, chunk) block computes its distances in numpy. Only k rows per
    query and block leave the block - never the pairs.
    """
    import pandas as pd

    qc = qrows.groupBy("__b").agg(F.count(F.lit(1)).alias("__nq"))
    qc = qc.select("__b", F.greatest(F.lit(1), F.ceil(F.col("__nq") / F.lit(CHUNK))).cast("int").alias("__nchunk"))
    qc = F.broadcast(qc)  # a row per block: the vectors are dealt once, by block and chunk
    q = (qrows.join(qc, "__b")
         .withColumn("__c", F.pmod(F.xxhash64(F.col("qid")), F.col("__nchunk")).cast("int")).drop("__nchunk"))
    r = rrows.join(qc, "__b").withColumn("__c", F.explode(F.sequence(F.lit(0), F.col("__nchunk") - 1))).drop("__nchunk")
    q = q.select(*[F.col(c).alias(c) for c in q.columns])  # other columns than those of the reference side
    qt, nt = id_types

    def block(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        return _nearest(qp, rp, k, exclude_self, radius)

    return (q.groupBy("__b", "__c").cogroup(r.groupBy("__b", "__c"))
            .applyInPandas(block, f"qid {qt}, nid {nt}, dist double"))


def knn_join(queries: DataFrame, reference: DataFrame | None = None, k: int = 5, id_col: str = "id",
             vec_col: str = "vec", exclude_self: bool = True, n_pivots: int = 4, bucket_rows: int = 1024,
             seed: int = 7, dedupe: bool = True) -> DataFrame:
    """Return ``(qid, nid, rank, dist)``: the k nearest reference rows of every query row.

    For a self join, identical vectors are collapsed first when any exist (see
    ``_knn_with_duplicates``), so a vector repeated a third of all rows never
    lands as one quadratic bucket.
    """
    if dedupe:
        ref = queries if reference is None else reference
        # cheap detection by a 64-bit hash; a collision only sends the join down the exact duplicate path
        vk = F.xxhash64(F.col(vec_col).cast("array<double>"))
        dup = (ref.groupBy(vk.alias("__vk")).agg(F.count(F.lit(1)).alias("m"))
               .where(F.col("m") > 1).limit(1).count())
        if dup and reference is None and exclude_self:
            return _knn_with_duplicates(queries, k, id_col, vec_col, n_pivots, bucket_rows, seed)
        if dup:
            return _knn_distinct_reference(queries, ref, k, id_col, vec_col, exclude_self, n_pivots,
                                           bucket_rows, seed)
    return _knn_join(queries, reference, k, id_col, vec_col, exclude_self, n_pivots, bucket_rows, seed)


def _smallest_ids(rows: DataFrame, kk: int) -> DataFrame:
    """``(vk, m, rep, ids)``: multiplicity, representative and the ``kk`` smallest ids of every vector key,
    by ``kk`` rounds of partial-aggregated ``min`` (no vector's rows are ever gathered in one task)."""
    groups = cut_lineage(rows.groupBy("vk").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("rep")))
    dup_rows = rows.join(groups.where(F.col("m") > 1).select("vk"), "vk", "left_semi").select("vk", "id")
    picked = dup_rows.groupBy("vk").agg(F.array(F.min("id")).alias("ids"))
    for _ in range(kk - 1):
        nxt = (dup_rows.join(picked, "vk").where(~F.array_contains("ids", F.col("id")))
               .groupBy("vk").agg(F.min("id").alias("nx")))
        picked = cut_lineage(picked.join(nxt, "vk", "left").select(
            "vk", F.when(F.col("nx").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("nx"))).alias("ids")))
    return cut_lineage(groups.join(picked, "vk", "left").select(
        "vk", "m", "rep", F.coalesce("ids", F.array("rep")).alias("ids")))


def _knn_distinct_reference(queries: DataFrame, reference: DataFrame, k: int, id_col: str, vec_col: str,
                            exclude_self: bool, n_pivots: int, bucket_rows: int, seed: int) -> DataFrame:
    """kNN against a reference with repeated vectors: search distinct reference vectors, each standing for
    its smallest ids; the k nearest rows lie among the k (+1 when excluding self) nearest distinct vectors."""
    kk = k + 1 if exclude_self else k
    vec = F.col(vec_col).cast("array<double>")
    rows = reference.select(F.col(id_col).alias("id"), vec.alias("vec"), F.md5(F.to_json(vec)).alias("vk"))
    small = _smallest_ids(rows, kk)
    reps = rows.join(small.select(F.col("rep").alias("id"), "vk"), ["id", "vk"], "left_semi").select("id", "vec")
    q = queries.select(F.col(id_col).alias("id"), vec.alias("vec"))
    dn = _knn_join(q, reps, kk, "id", "vec", False, n_pivots, bucket_rows, seed)
    cand = (dn.join(small.select(F.col("rep").alias("nid"), "ids"), "nid")
            .select("qid", "dist", F.explode(F.slice("ids", 1, kk)).alias("nid")))
    if exclude_self:
        cand = cand.where(F.col("qid") != F.col("nid"))
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "nid", F.col("rank").cast("int"), "dist"))


def _knn_with_duplicates(df: DataFrame, k: int, id_col: str, vec_col: str, n_pivots: int, bucket_rows: int,
                         seed: int) -> DataFrame:
    """Exact self kNN when vectors repeat.

    1. ``(vector key, multiplicity)`` by a partial-aggregated groupBy;
    2. the k+1 smallest ids of each repeated vector by k+1 rounds of ``min``
       (each a partial-aggregated groupBy - a hot vector never sits in one task);
    3. kNN over distinct vectors (one representative row each);
    4. a row's neighbours are the other rows of its own vector (distance 0,
       smallest ids first), then rows of the nearest distinct vectors (their
       smallest ids), ranked by (distance, id). Distance ties between distinct
       vectors at the k-th place are resolved among the k nearest vectors only.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec"), F.md5(F.to_json(vec)).alias("vk"))
    groups = rows.groupBy("vk").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("rep"))
    groups = cut_lineage(groups)
    dup_rows = rows.join(groups.where(F.col("m") > 1).select("vk"), "vk", "left_semi").select("vk", "id")
    picked = dup_rows.groupBy("vk").agg(F.array(F.min("id")).alias("ids"))
    for _ in range(k):
        nxt = (dup_rows.join(picked, "vk").where(~F.array_contains("ids", F.col("id")))
               .groupBy("vk").agg(F.min("id").alias("nx")))
        picked = cut_lineage(picked.join(nxt, "vk", "left").select(
            "vk", F.when(F.col("nx").isNull(), F.col("ids")).otherwise(F.concat("ids", F.array("nx"))).alias("ids")))
    small_ids = groups.join(picked, "vk", "left").select(
        "vk", "m", F.coalesce("ids", F.array("rep")).alias("ids"))
    small_ids = cut_lineage(small_ids)
    reps = rows.join(groups.select(F.col("rep").alias("id"), "vk"), ["id", "vk"], "left_semi")
    dn = _knn_join(reps.select("id", "vec"), None, k, "id", "vec", True, n_pivots, bucket_rows, seed)
    rep_vk = groups.select(F.col("rep"), "vk")
    # own-vector neighbours: other ids of the same vector, distance 0
    own = (rows.select("id", "vk").join(small_ids, "vk")
           .select(F.col("id").alias("qid"),
                   F.posexplode(F.slice(F.filter("ids", lambda x: x != F.col("id")), 1, k)).alias("pos", "nid"))
           .select("qid", "nid", F.lit(0.0).alias("dist")))
    # rows whose vector has fewer than k other copies need rows of neighbouring vectors
    short = rows.select("id", "vk").join(small_ids.where(F.col("m") - 1 < k).select("vk"), "vk")
    near = (dn.join(rep_vk.withColumnRenamed("rep", "qid").withColumnRenamed("vk", "qvk"), "qid")
            .join(rep_vk.withColumnRenamed("rep", "nid").withColumnRenamed("vk", "nvk"), "nid")
            .join(small_ids.withColumnRenamed("vk", "nvk"), "nvk")
            .select("qvk", "dist", F.explode(F.slice("ids", 1, k)).alias("nid")))
    other = short.join(near, short["vk"] == near["qvk"]).select(F.col("id").alias("qid"), "nid", "dist")
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    allc = own.unionByName(other)
    return (allc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "nid", F.col("rank").cast("int"), "dist"))


def _knn_join(queries: DataFrame, reference: DataFrame | None = None, k: int = 5, id_col: str = "id",
              vec_col: str = "vec", exclude_self: bool = True, n_pivots: int = 4, bucket_rows: int = 1024,
              seed: int = 7) -> DataFrame:
    """Return ``(qid, nid, rank, dist)``: the k nearest reference rows of every query row.

    ``reference`` defaults to ``queries`` (self join, the query row excluded when
    ``exclude_self``). Both sides carry ``id_col`` (unique) and ``vec_col`` (array<double>).
    """
    ref_src = queries if reference is None else reference
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("__v"))
    r = ref_src.select(F.col(id_col).alias("nid"), F.col(vec_col).cast("array<double>").alias("__v"))

    piv_rows = (r.orderBy(F.md5(F.concat(key_text(["nid"]), F.lit(f"|{seed}"))), "nid")
                .limit(n_pivots).select("__v").collect())
    pivots = [list(p["__v"]) for p in piv_rows]
    if not pivots:
        return queries.sparkSession.createDataFrame([], "qid bigint, nid bigint, rank int, dist double")
    # pivot distances as stored columns: inside the bucket function they would be computed again for every bound
    r = cut_lineage(_with_pivots(r, pivots).withColumn("__d1", F.col("__pd")[0]))
    if reference is None:
        q = r.select(F.col("nid").alias("qid"), *[F.col(c).alias(c) for c in ("__v", "__pd", "__d1")])
    else:
        q = cut_lineage(_with_pivots(q, pivots).withColumn("__d1", F.col("__pd")[0]))

    bucket_of, nb = _bucketizer(r, "__d1", bucket_rows)
    rr, boxes, strips = _blocks(r.withColumn("__g", bucket_of(F.col("__d1"))), len(pivots))
    q = q.withColumn("__qg", bucket_of(F.col("__d1")))
    id_types = (q.schema["qid"].dataType.simpleString(), rr.schema["nid"].dataType.simpleString())
    d2 = F.col("__pd")[min(1, len(pivots) - 1)]

    # ---- round 1: of the query's bucket and both neighbours, the blocks at and beside its place on the second pivot
    own = F.abs(F.col("__strip") - _strip(d2)) <= 1
    near = (q.withColumn("__g", F.explode(F.array(F.col("__qg") - 1, F.col("__qg"), F.col("__qg") + 1)))
            .join(F.broadcast(strips), "__g"))
    q1 = near.withColumn("__strip", F.explode(F.sequence(F.greatest(_strip(d2) - 1, F.lit(0)),
                                                         F.least(_strip(d2) + 1, F.col("__strips") - 1))))
    q1 = q1.join(F.broadcast(boxes.select("__g", "__strip", "__b")), ["__g", "__strip"]).select("qid", "__v", "__b")
    w = Window.partitionBy("qid").orderBy("dist", "nid")
    # k rows per query, read twice below: materialise once instead of recomputing the blocks
    top1 = cut_lineage(_block_topk(q1, rr, k, exclude_self, id_types)
                       .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

    # ---- round 2: every other block whose box over all pivot distances comes within the k-th distance found
    kth = top1.groupBy("qid").agg(F.max("dist").alias("__r"), F.count(F.lit(1)).alias("__n"))
    full = F.coalesce(F.col("__n"), F.lit(0)) >= k
    qs = q.join(kth, "qid", "left").withColumn("__rad", F.when(full, F.col("__r")).otherwise(F.lit(float("inf"))))
    inf = F.col("__rad") == float("inf")
    b_lo = F.when(inf, F.lit(0)).otherwise(bucket_of(F.col("__d1") - F.col("__rad") * (1 + EDGE)))
    b_hi = F.when(inf, F.lit(nb - 1)).otherwise(bucket_of(F.col("__d1") + F.col("__rad") * (1 + EDGE)))
    gap = F.array_max(F.zip_with("__pd", F.arrays_zip("__lo", "__hi"), lambda x, h: F.greatest(
        h["__lo"] - x, x - h["__hi"], F.lit(0.0))))
    seen = (F.abs(F.col("__g") - F.col("__qg")) <= 1) & own

    def others(some: DataFrame) -> DataFrame:
        return (some.withColumn("__g", F.explode(F.sequence(b_lo, b_hi))).join(F.broadcast(boxes.join(strips, "__g")), "__g")
                .where((gap <= F.col("__rad") * (1 + EDGE)) & ~seen))

    # where blocks can't be told apart by their boxes (many dimensions), nearly every query meets nearly every block:
    # rows in the fine blocks of the other queries, told from some of them, against rows in few large blocks
    n_q, n_r = qs.count(), rr.count()
    share = max(1, n_q // PROBE)
    pairs = others(qs.where(F.pmod(F.xxhash64("qid"), F.lit(share)) == 0).drop("__v")).count() * share
    parts_q, parts_r = _large_blocks(n_q), _large_blocks(n_r)
    if pairs * (1 + STRIP_ROWS / CHUNK) > n_q * parts_r + n_r * parts_q:
        found = _all_blocks(qs.where(F.col("__d1").isNotNull()).select("qid", "__v", "__rad"), rr, k, exclude_self,
                            id_types, parts_q, parts_r)
        return cut_lineage(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                           .select("qid", "nid", F.col("rank").cast("int"), "dist"))
    # dealt by number of queries: by bytes they would be one task's, whose ranges of buckets cost far more
    p2q = cut_lineage(others(qs.repartition(-(-n_q // PROBE) or 1, "qid")).select("qid", "__v", "__rad", "__b"))
    if p2q.isEmpty():
        return top1.select("qid", "nid", F.col("rank").cast("int"), "dist")
    p2 = _block_topk(p2q, rr, k, exclude_self, id_types, radius=True)
    both = top1.drop("rank").unionByName(p2)
    return cut_lineage(both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                       .select("qid", "nid", F.col("rank").cast("int"), "dist"))


PROBE = 20_000        # queries by which the pairs with other blocks are estimated
LARGE_ROWS = 65_536   # rows of a large block, at most about


def _large_blocks(n: int) -> int:
    """Four blocks, so that tasks share the work, of 2,048 rows at least; more above ``LARGE_ROWS`` rows each."""
    return max(1, min(4, n // 2048), -(-n // LARGE_ROWS))


def _all_blocks(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool, id_types: tuple[str, str],
                parts_q: int, parts_r: int) -> DataFrame:
    """k best (qid, nid, dist) within the radius of each query (qid, __v, __rad) per large block of reference rows
    (nid, __rv): all pairs of blocks, each a task's group. A row is copied once for every block of the other side."""
    import pandas as pd

    def part(col, n):
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select("qid", "__v", "__rad", part("qid", parts_q).alias("__i"), every(parts_r).alias("__j"))
    r = reference.select("nid", "__rv", part("nid", parts_r).alias("__rj"), every(parts_q).alias("__ri"))

    def block(qp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        return _nearest(qp, rp, k, exclude_self, True)
    return (q.groupBy("__i", "__j").cogroup(r.groupBy("__ri", "__rj"))
            .applyInPandas(block, f"qid {id_types[0]}, nid {id_types[1]}, dist double"))


STRIP_ROWS = 1024  # reference rows of a block, about
BLOCK_ROWS = 4096  # and at most, by hash
EDGE = 1e-9        # relative; bounds this near to the radius are compared


def _strip(d2: Column) -> Column:
    """Place of a second pivot distance among the equal-width strips of a bucket (``__lo2``, ``__w2``, ``__strips``)."""
    at = F.when(F.col("__w2") > 0, (d2 - F.col("__lo2")) / F.col("__w2") * F.col("__strips")).otherwise(F.lit(0.0))
    return F.least(F.greatest(F.floor(at), F.lit(0)), F.col("__strips") - 1).cast("int")


def _blocks(r: DataFrame, n_pivots: int):
    """Cut buckets ``__g`` into blocks: strips of the second pivot distance, and those by hash where still too large.

    Returns the rows with their block ``__b``, the block index (``__g, __strip, __b, __lo, __hi``: the range of every
    pivot distance in the block) and the strips (``__g, __lo2, __w2, __strips``)."""
    d2 = F.col("__pd")[min(1, n_pivots - 1)]
    strips = r.groupBy("__g").agg(F.min(d2).alias("__lo2"), (F.max(d2) - F.min(d2)).alias("__w2"),
                                  F.ceil(F.count(F.lit(1)) / F.lit(STRIP_ROWS)).cast("int").alias("__strips"))
    strips = _fresh(cut_lineage(strips))
    cut = r.join(F.broadcast(strips), "__g").withColumn("__strip", _strip(d2)).select("nid", "__v", "__pd", "__g", "__strip")
    parts = cut.groupBy("__g", "__strip").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("__parts"))
    name = F.concat_ws("-", "__g", "__strip", F.pmod(F.xxhash64("nid"), F.col("__parts")).cast("int"))
    rows = cut.join(F.broadcast(parts), ["__g", "__strip"]).withColumn("__b", name)
    rows = cut_lineage(rows.select("nid", F.col("__v").alias("__rv"), "__pd", "__g", "__strip", "__b"))
    low = F.array(*[F.min(F.col("__pd")[j]) for j in range(n_pivots)])
    high = F.array(*[F.max(F.col("__pd")[j]) for j in range(n_pivots)])
    boxes = rows.groupBy("__g", "__strip", "__b").agg(low.alias("__lo"), high.alias("__hi"))
    return _fresh(rows.select("nid", "__rv", "__b")), _fresh(cut_lineage(boxes)), _fresh(strips)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new ids: tables of one origin are joined with each other below."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def range_join(queries: DataFrame, reference: DataFrame | None = None, eps: float = 0.5, id_col: str = "id",
               vec_col: str = "vec", n_pivots: int = 4, seed: int = 7) -> DataFrame:
    """All reference rows within ``eps`` of each query row: ``(qid, nid, dist)`` (self pairs included).

    Buckets of width ``eps`` on the first pivot distance: a pair within eps
    differs by at most eps in every pivot distance, so it lies in the same or an
    adjacent bucket (equi-join on bucket id, three ids per query). The other
    pivots' lower bound prunes before the exact distance. Output size is the
    number of eps-close pairs, which is what the operator returns.
    """
    ref_src = queries if reference is None else reference
    q = queries.select(F.col(id_col).alias("qid"), F.col(vec_col).cast("array<double>").alias("__v"))
    r = ref_src.select(F.col(id_col).alias("nid"), F.col(vec_col).cast("array<double>").alias("__v"))
    piv_rows = (r.orderBy(F.md5(F.concat(key_text(["nid"]), F.lit(f"|{seed}"))), "nid")
                .limit(n_pivots).select("__v").collect())
    pivots = [list(p["__v"]) for p in piv_rows]
    if not pivots:
        return queries.sparkSession.createDataFrame([], "qid bigint, nid bigint, dist double")
    q = _with_pivots(q, pivots).withColumn("__b", F.floor(F.col("__pd")[0] / F.lit(eps)).cast("long"))
    r = _with_pivots(r, pivots).withColumn("__b", F.floor(F.col("__pd")[0] / F.lit(eps)).cast("long"))
    rr = r.select("nid", F.col("__v").alias("__rv"), F.col("__pd").alias("__rpd"), "__b")
    q1 = q.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    lb = F.aggregate(F.zip_with("__pd", "__rpd", lambda a, b: F.abs(a - b)), F.lit(0.0),
                     lambda acc, v: F.greatest(acc, v))
    pairs = q1.join(rr, "__b").where(lb <= F.lit(eps))
    return (pairs.select("qid", "nid", euclid(F.col("__v"), F.col("__rv")).alias("dist"))
            .where(F.col("dist") <= F.lit(eps)))
