"""Distributed running totals over an ordered numeric key.

A window ``ORDER BY key`` without ``PARTITION BY`` moves every row into one
task. Here rows are cut into ranges of bounded size (approximate quantiles,
then equal-width splits), range totals give each range its starting offset,
and the running sum is a window *inside each range* plus that offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import stored


def running_totals(df: DataFrame, key: str, cols: list[str], group: list[str] = (), bucket_rows: int = 100_000,
                   descending: bool = False) -> DataFrame:
    """Add ``cum_<c>``: sum of c over rows whose key is <= this row's key (>= when descending), per group.

    Ties share a value (range frame). Input should already be aggregated to one
    row per (group, key) for tie-heavy data. All groups go together: keys are cut
    by the two-level bucketizer of ``operators.knn`` (about ``bucket_rows`` rows of
    all groups per bucket, bounded literals), totals per (group, bucket) give
    offsets, and the window runs inside each (group, bucket) only. Null groups and
    any number of groups are allowed.
    """
    from tabwright.operators.knn import _bucketizer
    group = list(group)
    k = F.col(key).cast("double")
    # read by each step below, so that what makes the rows (predictions, a grouping) runs once
    d = stored(df.withColumn("__k", -k if descending else k))
    bucket_of, _ = _bucketizer(d, "__k", bucket_rows)
    d = d.withColumn("__b", bucket_of(F.col("__k")))
    tot = d.groupBy(*group, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    # a row per bucket and group: at most rows / bucket_rows of a group
    wo = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__b").alias("__ob"),
                      *[F.coalesce(F.sum(f"__t_{c}").over(wo), F.lit(0)).alias(f"__o_{c}") for c in cols])
    same = F.col("__b") == F.col("__ob")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    w = Window.partitionBy(*group, "__b").orderBy("__k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.join(offs, same)
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(w) + F.col(f"__o_{c}"))
    return out.drop("__k", "__b", "__ob", *[f"__o_{c}" for c in cols], *[f"__g_{g}" for g in group])
