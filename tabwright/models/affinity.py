"""Exemplars of affinity propagation over all pairs of rows, without a table of pairs.

With damping l, responsibilities after t rounds are ``r(i,k) = (1 - l^t) s(i,k) - b_t(i) + d_t(i,k)``: the similarity, a
number per row (damped maxima of a + s) and a correction where k was a row's own maximum in some round. Availabilities are
damped sums of ``min(0, c(k) - max(0, r(i,k)))`` over the rounds, c being a number per column and round. So the state is a
few numbers per row and round, and the messages of any pair follow from it.

A round is two passes over pairs of blocks of rows, each block of bounded size: the two largest a + s of every row, then the
sums of positive responsibilities of every column. In a block of pairs small boxes of near rows are compared with each
other; boxes too far apart to hold a row's two largest, or a positive responsibility, are left out, which changes nothing. Work
stays quadratic, times the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.ranks import numbered
from tabwright.session import release, stored

WHOLE = 2048         # rows up to which one task holds all pairs
BLOCK_ROWS = 65_536  # rows of a block at most, about
SUB_ROWS, SUB_COLS = 64, 256  # rows and columns of the boxes compared inside a block
BINS = 65_536        # of a histogram of distances
FEW = 200_000        # distances that are sorted in memory
EDGE = 1e-9          # relative; boxes this near to a bound are compared


def _parts(n: int) -> int:
    return max(1, min(4, n // 1024), -(-n // BLOCK_ROWS))


def _near_order(x):
    """Order of the rows along a Z-shaped curve over (at most four of) their dimensions."""
    import numpy as np
    d = min(x.shape[1], 4)
    lo, w = x.min(axis=0), np.ptp(x, axis=0)
    cell = ((x - lo) / np.where(w > 0, w, 1.0) * 1023).astype(np.int64)
    key = np.zeros(len(x), np.int64)
    for bit in range(10):
        for j in range(d):
            key |= ((cell[:, j] >> bit) & 1) << (bit * d + j)
    return np.argsort(key, kind="stable")


def _boxes(x, size: int):
    """(start, end, lowest, highest) of every ``size`` rows."""
    return [(s, min(s + size, len(x)), x[s:s + size].min(axis=0), x[s:s + size].max(axis=0)) for s in range(0, len(x), size)]


def _least_sq(a, b) -> float:
    import numpy as np
    gap = np.maximum(np.maximum(a[2] - b[3], b[2] - a[3]), 0.0)
    return float((gap * gap).sum())


def _sq(x, y):
    import numpy as np
    sq = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        sq += (x[:, j, None] - y[None, :, j]) ** 2
    return sq


def _frame(df, *arrays):
    """Rows of a block in ``_near_order`` (ties by idx): idx, vectors, and the array columns as (rounds, rows)."""
    import numpy as np
    df = df.sort_values("idx")
    x = np.stack(df["vec"].to_numpy()).astype(float)
    at = _near_order(x)
    df = df.iloc[at]
    return df["idx"].to_numpy(np.int64), x[at], df, [np.stack(df[a].to_numpy()).T for a in arrays]


def _tops(gap, top, jdx):
    """(row, column) places of the pairs of a block that were a row's maximum in some round; columns by their idx."""
    import numpy as np
    order = np.argsort(jdx, kind="stable")
    rows = np.broadcast_to(np.arange(top.shape[1]), top.shape).ravel()
    at = np.minimum(np.searchsorted(jdx[order], top.ravel()), len(jdx) - 1)
    hit = jdx[order][at] == top.ravel()
    pairs = np.unique(rows[hit] * len(jdx) + order[at][hit])
    return pairs // len(jdx), pairs % len(jdx)


def _corrections(gap, top, r, cols, damping: float):
    """d of the pairs (r, idx of the column) after each round."""
    import numpy as np
    d = np.zeros(len(r))
    for t in range(len(gap)):
        d = damping * d + (1 - damping) * np.where(top[t, r] == cols, gap[t, r], 0.0)
        yield d


def _two_largest(rp, cp, damping: float, same: bool):
    """(idx, v1, k1, v2): of every row the largest a + s over the block's columns, its column, and the second largest."""
    import numpy as np
    import pandas as pd
    idx, x, rdf, (b, gap, top) = _frame(rp, "b", "gap", "top")
    jdx, y, _, (c,) = _frame(cp, "c")
    rounds = len(b)
    weight = [(1 - damping) * damping ** (rounds - 1 - t) for t in range(rounds)]
    alpha = [1 - damping ** (t + 1) for t in range(rounds)]
    w = np.array(weight).reshape(-1, 1)
    wb, wc = b * w, c * w
    col_only = np.minimum(wc, 0.0)
    most = col_only.sum(axis=0)  # availabilities are this at most
    rb, cb = _boxes(x, SUB_ROWS), _boxes(y, SUB_COLS)
    peak = np.array([most[s:e].max() for s, e, _, _ in cb])
    c_low = np.array([[c[t, s:e].min() for s, e, _, _ in cb] for t in range(rounds)]).reshape(rounds, len(cb))
    # pairs with a correction, in full
    pr, pc = _tops(gap, top, jdx)
    if same:
        off = idx[pr] != jdx[pc]
        pr, pc = pr[off], pc[off]
    s_pair = -np.array([((x[pr, j] - y[pc, j]) ** 2) for j in range(x.shape[1])]).sum(axis=0)
    a_pair = np.zeros(len(pr))
    for t, d in enumerate(_corrections(gap, top, pr, jdx[pc], damping)):
        a_pair += np.minimum(wc[t, pc] - weight[t] * np.maximum(alpha[t] * s_pair - b[t, pr] + d, 0.0), 0.0)
    box = pr // SUB_ROWS * len(cb) + pc // SUB_COLS
    by_box = np.argsort(box, kind="stable")
    box = box[by_box]
    v1, v2 = np.full(len(x), -np.inf), np.full(len(x), -np.inf)
    k1 = np.full(len(x), -1, np.int64)
    if same:
        v1, k1 = rdf["own"].to_numpy(float).copy(), idx.copy()
    for i, rbox in enumerate(rb):
        rs, re = rbox[:2]
        sq_low = np.array([_least_sq(rbox, q) for q in cb])
        bound = peak - sq_low + EDGE * (np.abs(peak) + sq_low)
        b_low = b[:, rs:re].min(axis=1)
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] < v2[rs:re].min():
                break
            cs, ce = cb[j][:2]
            s = -_sq(x[rs:re], y[cs:ce])
            line, a, one = np.zeros(ce - cs), np.zeros_like(s), np.empty_like(s)
            for t in range(rounds):
                r_high = -alpha[t] * sq_low[j] - b_low[t]
                if r_high <= 0:
                    line += col_only[t, cs:ce]
                elif c_low[t, j] < r_high:
                    np.multiply(s, weight[t] * alpha[t], out=one)
                    one -= wb[t, rs:re, None]
                    np.maximum(one, 0.0, out=one)
                    np.subtract(wc[t, None, cs:ce], one, out=one)
                    np.minimum(one, 0.0, out=one)
                    a += one
            a += line
            p = by_box[slice(*np.searchsorted(box, [i * len(cb) + j, i * len(cb) + j + 1]))]
            a[pr[p] - rs, pc[p] - cs] = a_pair[p]
            a += s
            if same:
                k = np.arange(max(rs, cs), min(re, ce))
                a[k - rs, k - cs] = -np.inf
            at = a.argmax(axis=1)
            k = np.arange(re - rs)
            m1 = a[k, at]
            a[k, at] = -np.inf
            v2[rs:re] = np.maximum(np.maximum(v2[rs:re], a.max(axis=1)), np.minimum(v1[rs:re], m1))
            new = m1 > v1[rs:re]
            k1[rs:re] = np.where(new, jdx[cs:ce][at], k1[rs:re])
            v1[rs:re] = np.maximum(v1[rs:re], m1)
    return pd.DataFrame({"idx": idx, "v1": v1, "k1": k1, "v2": v2})


def _positive_sums(rp, cp, damping: float, pref: float, same: bool):
    """(idx, sp, rkk): of every column the sum of positive responsibilities of the block's other rows, and its own one."""
    import numpy as np
    import pandas as pd
    idx, x, _, (b, gap, top) = _frame(rp, "b", "gap", "top")
    jdx, y, _, _ = _frame(cp)
    b, alpha = b[-1], 1 - damping ** len(gap)
    pr, pc = _tops(gap, top, jdx)
    *_, d = _corrections(gap, top, pr, jdx[pc], damping)
    sums, own = np.zeros(len(y)), np.full(len(y), np.nan)
    if same:
        own = alpha * pref - b
        mine = idx[pr] == jdx[pc]
        own[pc[mine]] += d[mine]
        pr, pc, d = pr[~mine], pc[~mine], d[~mine]
    cb = _boxes(y, SUB_COLS)
    for rbox in _boxes(x, SUB_ROWS):
        rs, re = rbox[:2]
        low = b[rs:re].min()
        for q in cb:
            if -alpha * _least_sq(rbox, q) - low <= 0:
                continue
            cs, ce = q[:2]
            r = _sq(x[rs:re], y[cs:ce])
            r *= -alpha
            r -= b[rs:re, None]
            np.maximum(r, 0.0, out=r)
            if same:
                k = np.arange(max(rs, cs), min(re, ce))
                r[k - rs, k - cs] = 0.0
            sums[cs:ce] += r.sum(axis=0)
    plain = -alpha * np.array([((x[pr, j] - y[pc, j]) ** 2) for j in range(x.shape[1])]).sum(axis=0) - b[pr]
    np.add.at(sums, pc, np.maximum(plain + d, 0.0) - np.maximum(plain, 0.0))
    return pd.DataFrame({"idx": jdx, "sp": sums, "rkk": own})


def _exemplars_whole(points, rounds: int, damping: float):
    """The exemplars among all rows, in one task."""
    import numpy as np
    points = points.sort_values("idx")
    x = np.stack(points["vec"].to_numpy()).astype(float)
    n = len(x)
    s, k = -_sq(x, x), np.arange(n)
    if n > 1:
        s[k, k] = np.median(s[np.triu_indices(n, 1)]) or -1.0
        r, a = np.zeros_like(s), np.zeros_like(s)
        for _ in range(rounds):
            v = a + s
            top = v.argmax(axis=1)
            m1 = v[k, top]
            v[k, top] = -np.inf
            new = s - m1[:, None]
            new[k, top] = s[k, top] - v.max(axis=1)
            r = damping * r + (1 - damping) * new
            new = np.maximum(r, 0.0)
            new[k, k] = 0.0
            sp = new.sum(axis=0)
            new = np.minimum((r[k, k] + sp)[None, :] - new, 0.0)
            new[k, k] = sp
            a = damping * a + (1 - damping) * new
        points = points[(r + a)[k, k] > 0]
    return points[["idx"]]


def _paired(left: DataFrame, right: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(rows, columns, same block)`` of every pair of blocks, of frames with their block and that of the other side."""
    def block(rp, cp):
        import pandas as pd
        if not (len(rp) and len(cp)):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return fn(rp, cp, rp["i"].iloc[0] == rp["j"].iloc[0])
    right = right.withColumnsRenamed({"i": "ri", "j": "rj"})
    return left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInPandas(block, schema)


def _sides(points: DataFrame, parts: int, left: list, right: list, half: bool = False) -> tuple[DataFrame, DataFrame]:
    part = F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int")
    i, j = F.col("i"), F.col("j")
    rows = points.select(part.alias("i"), "idx", "vec", *left).withColumn(
        "j", F.explode(F.sequence(i if half else F.lit(0), F.lit(parts - 1))))
    cols = points.select(part.alias("j"), F.col("idx").alias("idx"), F.col("vec").alias("vec"), *right).withColumn(
        "i", F.explode(F.sequence(F.lit(0), j if half else F.lit(parts - 1))))
    return rows, cols


def median_sq(points: DataFrame, n: int) -> float:
    """Exact median of the squared distances of all pairs of the ``n`` rows (idx, vec), by histograms that narrow down."""
    import numpy as np
    import pandas as pd
    d = len(points.first()["vec"])
    box = points.agg(*[F.max(F.col("vec")[j]) - F.min(F.col("vec")[j]) for j in range(d)]).first()
    total = n * (n - 1) // 2
    lo, hi, cuts, before = 0.0, float(sum(v * v for v in box)), [], 0
    rows, cols = _sides(points, _parts(n), [], [], half=True)

    def chosen(rp, cp, same):
        x, y = np.stack(rp["vec"].to_numpy()).astype(float), np.stack(cp["vec"].to_numpy()).astype(float)
        xi, yi = rp["idx"].to_numpy(np.int64), cp["idx"].to_numpy(np.int64)
        step = max(1, (1 << 20) // len(y))
        for s in range(0, len(x), step):
            sq = _sq(x[s:s + step], y)
            sq = sq[xi[s:s + step, None] < yi[None, :]] if same else sq.ravel()
            for clo, scale, at in cuts:
                sq = sq[_bins(sq, clo, scale) == at]
            yield sq

    def _bins(sq, low, scale):
        return np.clip((sq - low) * scale, 0, BINS - 1).astype(np.int64)

    while True:
        if hi <= lo:
            return lo
        scale = BINS / (hi - lo)

        def counted(rp, cp, same, lo=lo, scale=scale):
            n_, low, high = np.zeros(BINS, np.int64), np.full(BINS, np.inf), np.full(BINS, -np.inf)
            for sq in chosen(rp, cp, same):
                at = _bins(sq, lo, scale)
                n_ += np.bincount(at, minlength=BINS)
                np.minimum.at(low, at, sq)
                np.maximum.at(high, at, sq)
            k = np.flatnonzero(n_)
            return pd.DataFrame({"bin": k, "n": n_[k], "low": low[k], "high": high[k]})
        found = (_paired(rows, cols, counted, "bin long, n long, low double, high double")
                 .groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
                 .orderBy("bin").collect())  # at most BINS rows
        ends = before + np.cumsum([r["n"] for r in found])
        first, second = (int(np.searchsorted(ends, rank, side="right")) for rank in ((total - 1) // 2, total // 2))
        if first != second:  # neighbours in order: the last of one bin and the first of the next
            return (found[first]["high"] + found[second]["low"]) / 2
        hit = found[first]
        before = int(ends[first]) - hit["n"]
        cuts = [*cuts, (lo, scale, hit["bin"])]
        lo, hi = hit["low"], hit["high"]
        if hit["n"] <= FEW and hi > lo:
            def values(rp, cp, same):
                return pd.DataFrame({"sq": np.concatenate([*chosen(rp, cp, same), np.zeros(0)])})
            sq = sorted(r["sq"] for r in _paired(rows, cols, values, "sq double").collect())
            return (sq[(total - 1) // 2 - before] + sq[total // 2 - before]) / 2


def exemplars(points: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(idx) of the exemplars of ``points`` (idx long, vec): similarities are negative squared distances of all pairs, the
    preference their median."""
    n = points.count()
    if n <= WHOLE:
        return points.select("idx", "vec").groupBy().applyInPandas(
            lambda p: _exemplars_whole(p, rounds, damping), "idx long")
    parts = _parts(n)
    pref = -median_sq(points, n) or -1.0
    none = F.array().cast("array<double>")
    state = points.select("idx", "vec", none.alias("b"), none.alias("gap"), none.cast("array<long>").alias("top"),
                          none.alias("c"), F.lit(0.0).alias("avail"), F.lit(0.0).alias("resp"))
    keep, old = F.lit(damping), []
    for _ in range(rounds):
        own = (F.col("avail") + F.lit(pref)).alias("own")
        found = _paired(*_sides(state, parts, ["b", "gap", "top", own], [F.col("c").alias("c")]),
                        lambda r, c, same: _two_largest(r, c, damping, same), "idx long, v1 double, k1 long, v2 double")
        best = found.groupBy("idx").agg(
            F.max(F.struct("v1", -F.col("k1"))).alias("m"),
            F.greatest(F.max("v2"), F.get(F.sort_array(F.collect_list("v1"), asc=False), F.lit(1))).alias("m2"))
        best = best.select("idx", F.col("m.v1").alias("m1"), (-F.col("m.col2")).alias("k1"), "m2")
        last = F.coalesce(F.get("b", F.size("b") - 1), F.lit(0.0))
        state = stored(state.join(best, "idx").select(
            "idx", "vec", F.concat("b", F.array(keep * last + (1 - keep) * F.col("m1"))).alias("b"),
            F.concat("gap", F.array(F.col("m1") - F.col("m2"))).alias("gap"),
            F.concat("top", F.array("k1")).alias("top"), "c", "avail"))
        sums = _paired(*_sides(state, parts, ["b", "gap", "top"], []),
                       lambda r, c, same: _positive_sums(r, c, damping, pref, same), "idx long, sp double, rkk double")
        sums = stored(sums.groupBy("idx").agg(
            F.sum("sp").alias("sp"), F.max(F.when(~F.isnan("rkk"), F.col("rkk"))).alias("resp")))
        for table in old:  # a round's tables replace those of the round before
            release(table)
        old = [state, sums]
        state = state.join(sums, "idx").select(
            "idx", "vec", "b", "gap", "top", F.concat("c", F.array(F.col("resp") + F.col("sp"))).alias("c"),
            (keep * F.col("avail") + (1 - keep) * F.col("sp")).alias("avail"), "resp")
    return state.where(F.col("avail") + F.col("resp") > 0).select("idx")


def label_rows(v: DataFrame, rounds: int, damping: float) -> DataFrame:
    """(id, cluster) of the rows (id, vec): the place of the nearest exemplar's id among all exemplars' ids, -1 without one
    and for rows without an id."""
    from tabwright.operators.knn import knn_join
    from tabwright.session import cut_lineage
    points = cut_lineage(numbered(v.where(F.col("id").isNotNull()), ["id"], "idx").select("idx", "id", "vec"))
    ex = points.join(exemplars(points, rounds, damping), "idx").groupBy("vec").agg(F.min("idx").alias("idx"))
    ex = cut_lineage(numbered(ex, ["idx"], "cluster").select("idx", "vec", F.col("cluster").cast("int")))
    none = v.where(F.col("id").isNull()).select("id", F.lit(-1).alias("cluster"))
    if ex.isEmpty():
        return points.select("id", F.lit(-1).alias("cluster")).unionByName(none)
    near = knn_join(points, ex, 1, "idx", "vec", exclude_self=False)
    named = near.select(F.col("qid").alias("idx"), "nid").join(ex.select(F.col("idx").alias("nid"), "cluster"), "nid")
    return points.select("idx", "id").join(named, "idx").select("id", "cluster").unionByName(none)
