"""Samples, splits, folds and random undersampling keyed on md5 of the row key.

All draws hash ``key||'|'||seed``: reproducible, stable under repartitioning and
task retries, and repeatable in SQL. Exact sizes use ``functions.ranks``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import md5_order, md5_unit
from tabwright.functions.ranks import numbered, select_first
from tabwright.session import cut_lineage

STRATIFY_MAX_CLASSES = 20  # fixed value: stratify when the target has fewer distinct values


def sample_size(rows: int, pct: float) -> int:
    return int(rows * pct / 100)


def n_classes_capped(df: DataFrame, target: str, cap: int) -> int:
    """Distinct target values, counted only up to ``cap + 1`` (bounded work on the driver)."""
    return df.select(target).distinct().limit(cap + 1).count()


def guess_task(df: DataFrame, targets: list[str]) -> DataFrame:
    """``(target, n_distinct, task)``: classification for text, booleans and fewer than 20 distinct values, else regression.

    Distinct values (nulls left out) are counted over all rows in one aggregation.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in targets]).unpivot([], targets, "target", "value")
    n = long.groupBy("target").agg(F.countDistinct("value").alias("n_distinct"))
    number = [c for c in targets if isinstance(kinds[c], T.NumericType)]
    task = F.when(F.col("target").isin(number) & (F.col("n_distinct") >= STRATIFY_MAX_CLASSES), "regression")
    return n.select("target", "n_distinct", task.otherwise("classification").alias("task"))


def _class_counts(df: DataFrame, target: str, cap: int = 10_000) -> dict:
    """Rows per class; refuses targets with more than ``cap`` classes instead of collecting them."""
    if n_classes_capped(df, target, cap) > cap:
        raise ValueError(f"target {target!r} has more than {cap} classes")
    return {(r[target],): r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}


def largest_remainder(counts: dict, total: int) -> dict:
    """Split ``total`` draws over classes in proportion; leftovers to the largest remainders (ties: class order)."""
    n_all = sum(counts.values())
    if n_all == 0:
        return {g: 0 for g in counts}
    base = {g: (c * total) // n_all for g, c in counts.items()}
    left = total - sum(base.values())
    rema = sorted(counts, key=lambda g: (-((counts[g] * total) % n_all), _sortkey(g)))
    for g in rema[:left]:
        base[g] += 1
    return base


def _sortkey(g):
    return tuple((v is None, v) for v in g)


FEW_CLASSES = 10_000   # up to so many, class quotas are a dictionary on the driver; beyond, a table
WINDOW_ROWS = 100_000  # a class of more rows is cut by hash prefixes, not sorted in one task


def _largest_remainder_table(counts: DataFrame, n_all: int, total: int) -> DataFrame:
    """``largest_remainder`` over a table (cls, n): adds ``q``."""
    wide = "cast(n as decimal(19, 0)) * cast({} as decimal(19, 0))".format(total)
    parts = cut_lineage(counts.withColumn("base", F.expr(f"({wide}) div cast({n_all} as decimal(19, 0))"))
                        .withColumn("rem", F.expr(f"({wide}) % cast({n_all} as decimal(19, 0))")))
    left = total - parts.agg(F.sum("base")).first()[0]
    ranked = numbered(parts.withColumn("__neg", -F.col("rem")).withColumn("__null", F.col("cls").isNull()),
                      ["__neg", "__null", "cls"], "rank")
    return ranked.select("cls", "n", (F.col("base") + (F.col("rank") < left).cast("long")).alias("q"))


def _first_of_many_classes(df: DataFrame, target: str, quota, h, tiebreaks: list[str], flag: str | None = None) -> DataFrame:
    """The first ``q`` rows of each class in the order of ``h`` and the tie-breaks, or all rows with a ``flag``. Class
    counts and quotas stay a distributed table; only classes of more than ``WINDOW_ROWS`` rows reach the driver."""
    counts = cut_lineage(df.groupBy(F.col(target).alias("cls")).agg(F.count(F.lit(1)).alias("n")))
    quotas = cut_lineage(quota(counts).select("cls", "n", "q"))
    large = {(r["cls"],): r["q"] for r in quotas.where(F.col("n") > WINDOW_ROWS).collect()}
    small = quotas.where(F.col("n") <= WINDOW_ROWS).select(F.col("cls").alias("__cls"), F.col("q").alias("__q"))
    w = Window.partitionBy(target).orderBy("__h", *tiebreaks)
    out = (df.join(small, df[target].eqNullSafe(small["__cls"])).withColumn("__h", h)
           .withColumn("__take", F.row_number().over(w) <= F.col("__q")))
    out = out.select(*df.columns, F.col("__take").alias(flag)) if flag else out.where("__take").select(*df.columns)
    if large:
        big = quotas.where(F.col("n") > WINDOW_ROWS).select(F.col("cls").alias("__cls"))
        rows = df.join(big, df[target].eqNullSafe(big["__cls"]), "left_semi")
        out = out.unionByName(select_first(rows, h, tiebreaks, large, [target], flag=flag))
    return out


def random_sample(df: DataFrame, pct: float, key: list[str], tiebreaks: list[str] = (), seed: int = 42) -> DataFrame:
    """Exactly int(rows * pct / 100) rows: the smallest md5(key|seed) values. pct >= 100 is a no-op."""
    if pct >= 100:
        return df
    return select_first(df, md5_order(key, seed), list(tiebreaks),
                        lambda counts: {g: sample_size(c, pct) for g, c in counts.items()}, [])


def stratified_sample(df: DataFrame, target: str, pct: float, key: list[str], tiebreaks: list[str] = (),
                      seed: int = 42) -> DataFrame:
    """Sample of int(rows*pct/100) rows keeping class shares (largest remainder); falls back to
    ``random_sample`` when the target has ``STRATIFY_MAX_CLASSES`` or more distinct values (nulls count)."""
    if pct >= 100:
        return df
    if n_classes_capped(df, target, STRATIFY_MAX_CLASSES) >= STRATIFY_MAX_CLASSES:
        return random_sample(df, pct, key, tiebreaks, seed)
    def quotas(counts):
        return largest_remainder(counts, sample_size(sum(counts.values()), pct))
    return select_first(df, md5_order(key, seed), list(tiebreaks), quotas, [target])


def train_test_split(df: DataFrame, key: list[str], train_size: float = 0.8, target: str | None = None,
                     tiebreaks: list[str] = (), seed: int = 123, flag: str = "is_train") -> DataFrame:
    """Flag exactly floor(rows*train_size) rows as training (stratified by ``target`` when given)."""
    if target:
        if n_classes_capped(df, target, FEW_CLASSES) > FEW_CLASSES:
            def shares(counts):
                total = counts.agg(F.sum("n")).first()[0]
                return _largest_remainder_table(counts, total, int(math.floor(total * train_size)))
            return _first_of_many_classes(df, target, shares, md5_order(key, seed), list(tiebreaks), flag)

        def quotas(counts):
            return largest_remainder(counts, int(math.floor(sum(counts.values()) * train_size)))
        return select_first(df, md5_order(key, seed), list(tiebreaks), quotas, [target], flag=flag)
    return select_first(df, md5_order(key, seed), list(tiebreaks),
                        lambda counts: {g: int(math.floor(c * train_size)) for g, c in counts.items()}, [], flag=flag)


def kfold(df: DataFrame, key: list[str], k: int = 5, seed: int = 123, col: str = "fold") -> DataFrame:
    """Fold id = first 8 hex digits of md5(key|seed) mod k (narrow projection, no shuffle)."""
    if k < 2:
        raise ValueError("k must be at least 2")
    return df.withColumn(col, F.pmod(md5_unit(key, seed), F.lit(k)).cast("int"))


def undersample(df: DataFrame, target: str, key: list[str], tiebreaks: list[str] = (), seed: int = 42) -> DataFrame:
    """Random undersampling: every class keeps as many rows as the smallest class."""
    if n_classes_capped(df, target, FEW_CLASSES) > FEW_CLASSES:
        def smallest(counts):
            return counts.withColumn("q", F.lit(counts.agg(F.min("n")).first()[0]))
        return _first_of_many_classes(df, target, smallest, md5_order(key, seed), list(tiebreaks))

    def quotas(counts):
        m = min(counts.values()) if counts else 0
        return {g: m for g in counts}
    return select_first(df, md5_order(key, seed), list(tiebreaks), quotas, [target])


def random_sample_fast(df: DataFrame, pct: float, seed: int = 42) -> DataFrame:
    """Approximate-size Bernoulli sample (``DataFrame.sample``): one narrow pass, no count.

    The size is only expected to be pct % and the draw depends on the input
    partitioning; use ``random_sample`` for the exact, partition-independent form.
    """
    return df if pct >= 100 else df.sample(withReplacement=False, fraction=pct / 100.0, seed=seed)


def stratified_sample_fast(df: DataFrame, target: str, pct: float, seed: int = 42) -> DataFrame:
    """Approximate stratified sample (``sampleBy``) with the same fraction in every stratum."""
    if pct >= 100:
        return df
    if n_classes_capped(df, target, STRATIFY_MAX_CLASSES) >= STRATIFY_MAX_CLASSES:
        return random_sample_fast(df, pct, seed)
    classes = [r[0] for r in df.select(target).distinct().collect()]  # fewer than STRATIFY_MAX_CLASSES
    return df.sampleBy(target, {c: pct / 100.0 for c in classes}, seed)
