"""Exact, distributed quantiles with linear interpolation (pandas / DuckDB ``quantile_cont``) by bracketed ranks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SKETCH = 10_000        # accuracy of the rank sketch: ranks are told to about 1 / SKETCH of the rows
INSIDE = 4_000_000     # rows of an interval that are sorted at once


def quantile_table(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of numeric columns of a wide table: ``(column, p, q)``, a row for every
    column with a value.

    Brackets instead of a table of all values: one scan sketches each column and gives edges around every wanted rank;
    a second counts the values at and between the edges; only the values of an interval that holds a wanted rank, about
    ``2 / SKETCH`` of the rows, are grouped and sorted. A rank that falls on an edge needs no sort, and an interval of
    more than ``INSIDE`` rows gets edges by a sketch of its own, so a hot value ends up as an edge and a window sorts
    no more rows than that.
    """
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, p double, q double")
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    step = 2.0 / SKETCH
    asked = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-step, 0.0, step)})
    first = x.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))],
                  *[F.percentile_approx(f"c{i}", asked, SKETCH).alias(f"s{i}") for i in range(len(cols))]).first()
    edges = {i: sorted(set(first[f"s{i}"])) for i in range(len(cols)) if first[f"n{i}"]}
    ranks = {}  # (column, p) -> the two ranks to mix and the second one's share
    for i in edges:
        for p in probs:
            pos = (first[f"n{i}"] - 1) * p
            ranks[i, p] = (math.floor(pos), min(math.floor(pos) + 1, first[f"n{i}"] - 1), pos - math.floor(pos))
    value: dict = {}  # (column, rank) -> value
    wanted = {(i, r) for (i, _), (a, b, _) in ranks.items() for r in (a, b)}
    while wanted:
        at = sorted({i for i, _ in wanted})
        coded = _coded(x, {i: edges[i] for i in at})
        counts: dict = {i: [] for i in at}
        for r in coded.groupBy("i", "c").agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect():
            counts[r["i"]].append((r["c"], r["n"]))  # two an edge at most
        small, large = {}, {}
        for i, r in list(wanted):
            below = 0
            for c, n in counts[i]:
                if r < below + n:
                    break
                below += n
            if c % 2:
                value[i, r] = edges[i][c // 2]
                wanted.discard((i, r))
            else:
                (small if n <= INSIDE else large).setdefault((i, c), []).append((r, r - below, n))
        if small:
            found = _sorted_inside(coded, {k: [o for _, o, _ in v] for k, v in small.items()})
            for (i, c), rs in small.items():
                value.update({(i, r): found[i, c, o] for r, o, _ in rs})
                wanted.difference_update((i, r) for r, _, _ in rs)
        if large:
            keys = list(large)
            cut = coded.agg(*[F.percentile_approx(F.when((F.col("i") == i) & (F.col("c") == c), F.col("v")), sorted(
                {min(max((o + 0.5) / n + d, 0.0), 1.0) for _, o, n in large[i, c] for d in (-step, 0.0, step)}),
                SKETCH).alias(f"s{t}") for t, (i, c) in enumerate(keys)]).first()
            for t, (i, _) in enumerate(keys):
                edges[i] = sorted({*edges[i], *cut[f"s{t}"]})
    out = [(cols[i], float(p), value[i, a] + f * (value[i, b] - value[i, a])) for (i, p), (a, b, f) in ranks.items()]
    return spark.createDataFrame(out, "column string, p double, q double")


def _coded(x: DataFrame, edges: dict[int, list[float]]) -> DataFrame:
    """(i, v, c) of the columns with edges: ``c`` is 2 j strictly between the edges j - 1 and j, 2 j + 1 at the edge j.

    The edges are one constant looked up by column; comparisons spelt out for every column and edge would be more code
    than a JVM compiles."""
    own = sorted(edges)
    table = F.array(*[F.array(*[F.lit(float(e)) for e in edges[i]]) for i in own])
    v = F.col("v")
    code = F.aggregate(F.get(table, F.col("p")), F.lit(0), lambda s, e: s + F.when(v > e, 2).when(v == e, 1).otherwise(0))
    return (x.select(F.posexplode(F.array(*[F.col(f"c{i}") for i in own])).alias("p", "v")).where("v is not null")
            .select(F.get(F.array(*[F.lit(i) for i in own]), F.col("p")).alias("i"), "v", code.alias("c")))


def _sorted_inside(coded: DataFrame, places: dict) -> dict:
    """(column, code, place) -> value, for places inside intervals: ``places`` is (column, code) -> places."""
    here = reduce(lambda a, b: a | b, [(F.col("i") == i) & (F.col("c") == c) for i, c in places])
    inside = coded.where(here).groupBy("i", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("i", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = inside.withColumn("end", F.sum("n").over(w))
    asked = [(i, c, o) for (i, c), os in places.items() for o in os]
    hit = reduce(lambda a, b: a | b, [(F.col("i") == i) & (F.col("c") == c) & (F.col("end") > o)
                                      & (F.col("end") - F.col("n") <= o) for i, c, o in asked])
    rows = ends.where(hit).collect()  # one row a place at most
    return {(i, c, o): next(r["v"] for r in rows if (r["i"], r["c"]) == (i, c) and r["end"] - r["n"] <= o < r["end"])
            for i, c, o in asked}


def quantile_dict(df: DataFrame, cols: list[str], probs: list[float]) -> dict[tuple[str, float], float]:
    """Fitted constants for transforms (robust scaling, median imputation): small, one per column x p."""
    return {(r["column"], r["p"]): r["q"] for r in quantile_table(df, cols, probs).collect()}
