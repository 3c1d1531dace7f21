"""Exact per-group "first n rows in hash order" without a global sort.

``row_number() over (partition by g order by h)`` sends each group to one task;
a group may hold a third of all rows. Instead the n-th key of every group is
located by refining on hash prefixes: count rows per (group, next prefix
digits) - a partial-aggregated table of at most groups x 16**step rows - pick
the prefix holding rank n, and repeat only inside that prefix until it holds
few rows; then a window over that small remainder yields the exact cutoff key.
Selection is a plain filter ``(h, tiebreaks...) <= cutoff`` joined with a
broadcast table of one cutoff per group (groups are few by contract: strata).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import cut_lineage


def _gkey(by: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))


def rank_cutoffs(df: DataFrame, h: Column, tiebreaks: list[str], quotas: dict, by: list[str],
                 step: int = 3, window_limit: int = 100_000) -> dict:
    """Return {group tuple: ("all"|"none"|cut tuple)} so that rows with (h, tiebreaks) <= cut are the first quota.

    ``quotas`` maps a group tuple (values of ``by``; ``()`` when ``by`` is empty) to n, or is a callable
    receiving ``{group: row count}`` and returning that mapping. Groups missing from it get 0.
    """
    base = df.select(_gkey(by).alias("__g"), h.alias("__h"), *[F.col(t) for t in tiebreaks])
    # one job gives every group's size and its first refinement level (counts per 3-hex-digit prefix)
    first = (base.groupBy("__g", F.substring("__h", 1, step).alias("__q"))
             .agg(F.count(F.lit(1)).alias("n")).collect())  # at most groups x 16**step rows
    per0: dict = {}
    for r in first:
        g = tuple(r["__g"]) if by else ()
        per0.setdefault(g, []).append((r["__q"], r["n"]))
    counts = {g: sum(n for _, n in lst) for g, lst in per0.items()}
    if callable(quotas):
        quotas = quotas(counts)
    result: dict = {}
    active: dict = {}
    for g, n_g in counts.items():
        q = int(quotas.get(g, 0))
        if q <= 0:
            result[g] = "none"
        elif q >= n_g:
            result[g] = "all"
        else:
            lst = sorted(per0[g])
            acc = 0
            for pq, n in lst:
                if acc + n >= q:
                    # prefix, remaining rank, rows under prefix, whether the prefix is a whole key
                    active[g] = [pq, q - acc, n, len(pq) < step]
                    break
                acc += n
    spark = df.sparkSession
    gtype = base.schema["__g"].dataType.simpleString()
    while active:
        # a prefix that holds one key only can't be refined: there the tie-breaks decide
        for g in [g for g, v in active.items() if v[2] > window_limit and v[3]]:
            p, r = active.pop(g)[:2]
            own = base.where(F.col("__g").eqNullSafe(_lit_group(g, by, base)) & (F.col("__h") == F.lit(p)))
            result[g] = (p, *_nth_row(own.select(*tiebreaks), tiebreaks, r)) if tiebreaks else (p,)
        coarse = {g: v for g, v in active.items() if v[2] > window_limit}
        fine = {g: v for g, v in active.items() if v[2] <= window_limit}
        if fine:
            gt = spark.createDataFrame([(_row(g, by), v[0], v[1]) for g, v in fine.items()],
                                       f"__g {gtype}, __p string, __r bigint")
            w = Window.partitionBy("__g").orderBy("__h", *tiebreaks)
            cand = (base.join(F.broadcast(gt), "__g")
                    .where(F.substring("__h", 1, F.length("__p")) == F.col("__p"))
                    .withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == F.col("__r")))
            for r in cand.collect():
                g = tuple(r["__g"]) if by else ()
                result[g] = tuple([r["__h"]] + [r[t] for t in tiebreaks])
                active.pop(g)
        if coarse:
            plen = len(next(iter(coarse.values()))[0])
            gt = spark.createDataFrame([(_row(g, by), v[0]) for g, v in coarse.items()],
                                       f"__g {gtype}, __p string")
            sub = (base.join(F.broadcast(gt), "__g")
                   .where(F.substring("__h", 1, plen) == F.col("__p"))
                   .groupBy("__g", F.substring("__h", 1, plen + step).alias("__q"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())
            per: dict = {}
            for r in sub:
                g = tuple(r["__g"]) if by else ()
                per.setdefault(g, []).append((r["__q"], r["n"]))
            for g, lst in per.items():
                lst.sort()
                rem = active[g][1]
                acc = 0
                for q, n in lst:
                    if acc + n >= rem:
                        active[g] = [q, rem - acc, n, len(q) < plen + step]
                        break
                    acc += n
    return result


def _lit_group(g: tuple, by: list[str], base: DataFrame) -> Column:
    return F.struct(*[F.lit(v).alias(c) for c, v in zip(by or ["_"], _row(g, by))]).cast(base.schema["__g"].dataType)


def _nth_row(rows: DataFrame, order: list[str], n: int) -> tuple:
    """The n-th row (from 1) in ascending order: one range sort, partition counts, one look-up."""
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        if n <= r["n"]:
            return tuple(ranged.where(F.col("__id") == (r["part"] << 33) + n - 1).select(*order).first())
        n -= r["n"]
    raise ValueError("fewer rows than the rank asked for")


def _row(g: tuple, by: list[str]):
    return tuple(g) if by else (0,)


def select_first(df: DataFrame, h: Column, tiebreaks: list[str], quotas: dict, by: list[str],
                 flag: str | None = None, **kw) -> DataFrame:
    """Rows whose rank in (h, tiebreaks) order within their group is <= quota (or flag them)."""
    cuts = rank_cutoffs(df, h, tiebreaks, quotas, by, **kw)
    conds = None
    key = F.struct(h.alias("h"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tiebreaks)])
    for g, cut in cuts.items():
        if cut == "none":
            continue
        if by:
            gc = None
            for c, v in zip(by, g):
                e = F.col(c).eqNullSafe(F.lit(v))
                gc = e if gc is None else gc & e
        else:
            gc = F.lit(True)
        if cut != "all":
            lit = F.struct(F.lit(cut[0]).alias("h"), *[F.lit(v).alias(f"t{i}") for i, v in enumerate(cut[1:])])
            gc = gc & (key <= lit)
        conds = gc if conds is None else conds | gc
    if conds is None:
        conds = F.lit(False)
    if flag:
        return df.withColumn(flag, conds)
    return df.where(conds)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Append the row's 0-based place (long) in ascending ``order`` (nulls first): a range shuffle, then the place in the
    partition plus the rows of the partitions before. Only one count per partition reaches the driver."""
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    starts, total = [], 0
    for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        starts.append((r["p"], total))
        total += r["n"]
    at = df.sparkSession.createDataFrame(starts, "__p long, __start long")
    return (placed.withColumn("__p", part).join(F.broadcast(at), "__p")
            .withColumn(out, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__p", "__start", "__id"))
