"""Grid index for searches within a fixed radius (Euclidean), without a table of close pairs.

Points lie in cells of side ``radius / sqrt(d)``, so that any two points of a cell are within the radius. A query meets
cells, not points: a cell that lies within the radius whole counts by its totals, a cell beyond it is skipped, and only
the points of cells that the radius cuts are compared, in numpy blocks of at most ``CHUNK`` x ``CHUNK`` points.
Cells are found by an equi-join on coarser cells of side ``2 * radius`` over the (at most three) widest dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage

CHUNK = 4096
SLICE = 256  # queries compared at once
EDGE = 1e-9  # relative; distances this near to the radius are always computed
GROUP_ROWS = 40_000  # rows that a task's group of blocks holds, about: a group of its own for every small block costs far more


def _dealt_groups(sizes: DataFrame, rows: Column) -> int:
    """Number of groups that blocks of these many ``rows`` in all are dealt to."""
    total = sizes.agg(F.sum(rows)).first()[0] or 0
    return max(2 * sizes.sparkSession.sparkContext.defaultParallelism, -(-int(total) // GROUP_ROWS))


class Grid:
    """``points``: (id, vec, ...) without nulls; other columns may be summed or compared."""

    def __init__(self, points: DataFrame, d: int, radius: float):
        self.d, self.radius = d, float(radius)
        self.side = self.radius / math.sqrt(max(d, 1)) * (1 - EDGE)
        box = F.transform("vec", lambda x: F.floor(x / F.lit(self.side)).cast("long"))
        self.points = cut_lineage(points.withColumn("box", box).withColumn("cell", F.array_join("box", ",")))
        wide = [F.approx_count_distinct(F.floor(F.col("vec")[j] / F.lit(self.radius))).alias(str(j)) for j in range(d)]
        spread = self.points.agg(*wide).first()
        self.axes = sorted(range(d), key=lambda j: (-(spread[str(j)] or 0), j))[:3]

    def cells(self, *totals: Column) -> DataFrame:
        """(cell, box, n, ...) of the occupied cells with aggregates over their points."""
        return self.points.groupBy("cell").agg(F.first("box").alias("box"), F.count(F.lit(1)).alias("n"), *totals)

    def _coarse(self, box: Column) -> Column:
        return F.array(*[F.floor(box[j] * F.lit(self.side / (2 * self.radius))).cast("long") for j in self.axes])

    def pairs(self, left: DataFrame, right: DataFrame, keep: list[str] = ("cell",)) -> DataFrame:
        """(cell, other) of ``left`` and ``right`` (cell, box) whose points may be within the radius, own cells too."""
        # lower corners of cells in reach are at most radius + side apart, less than a coarse cell
        steps = [F.array(*[F.lit(s).cast("long") for s in o]) for o in product((-1, 0, 1), repeat=len(self.axes))]
        a = left.select(*keep, "box", F.explode(F.array(*[
            F.zip_with(self._coarse(F.col("box")), s, lambda x, y: x + y) for s in steps])).alias("at"))
        b = right.select(F.col("cell").alias("other"), F.col("box").alias("obox"), self._coarse(F.col("box")).alias("at"))
        gap = F.aggregate(F.zip_with("box", "obox", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double")),
                          F.lit(0.0), lambda s, v: s + v * v)
        return (a.join(b, "at").where(F.sqrt(gap) * F.lit(self.side) <= F.lit(self.radius * (1 + EDGE)))
                .select(*keep, "other", "obox"))

    def meet(self, queries: DataFrame, cells: DataFrame, few: bool = False) -> DataFrame:
        """Queries (id, vec) with the occupied cells in reach: (id, vec, other, whole). ``few``: there are fewer
        queries than cells, so they look for cells one by one."""
        box = F.transform("vec", lambda x: F.floor(x / F.lit(self.side)).cast("long"))
        q = queries.select("id", "vec", box.alias("box"))
        if few:
            met = self.pairs(q, cells, ["id", "vec"])
        else:
            q = q.withColumn("cell", F.array_join("box", ","))
            homes = q.groupBy("cell").agg(F.first("box").alias("box"))
            met = q.drop("box").join(self.pairs(homes, cells), "cell")
        side = F.lit(self.side)

        def bound(far: bool):
            def of(x, b):
                lo, hi = b * side, (b + 1) * side
                return F.greatest(F.abs(x - lo), F.abs(x - hi)) if far else F.greatest(lo - x, x - hi, F.lit(0.0))
            return F.sqrt(F.aggregate(F.zip_with("vec", "obox", of), F.lit(0.0), lambda s, v: s + v * v))
        return (met.where(bound(False) <= F.lit(self.radius * (1 + EDGE)))
                .select("id", "vec", "other", (bound(True) <= F.lit(self.radius * (1 - EDGE))).alias("whole")))

    def compare(self, met: DataFrame, points: DataFrame, value: str, combine: Callable, schema: str,
                keep: str | None = None) -> DataFrame:
        """(id, value) per block: ``combine(near, values)`` for queries (id, vec, other, whole) against the ``points``
        (cell, vec, value) of that cell, ``near`` being the boolean matrix of the pairs within the radius. A query that
        has the cell whole within the radius gets what all of the block's points give together. ``keep`` names the
        column that returns the cell compared with."""
        import numpy as np
        import pandas as pd
        radius = self.radius

        def chunks(df, cell, name):
            n = df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias(name),
                                     F.count(F.lit(1)).alias(f"{name}_rows"))
            return n.withColumnRenamed(cell, "__cell")

        def part(df, n):
            return F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")

        queries = cut_lineage(met)
        nq, np_ = chunks(queries, "other", "__nq"), chunks(points, "cell", "__np")
        sizes = cut_lineage(nq.join(np_, "__cell"))
        q = queries.join(sizes, queries["other"] == sizes["__cell"])
        q = q.withColumn("__q", part(queries, "__nq")).withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__np") - 1)))
        p = points.select("cell", "vec", value)
        p = p.join(sizes, p["cell"] == sizes["__cell"])
        p = p.withColumn("__p", part(points.select("cell", "vec", value), "__np")).withColumn(
            "__q", F.explode(F.sequence(F.lit(0), F.col("__nq") - 1)))
        q = q.select(F.col("__cell").alias("qc"), F.col("__q").alias("qq"), F.col("__p").alias("qp"),
                     F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("whole").alias("whole"))
        p = p.select(F.col("__cell").alias("pc"), F.col("__q").alias("pq"), F.col("__p").alias("pp"),
                     F.col("vec").alias("vec"), F.col(value).alias(value))

        def block(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
            names = [c.split()[0].strip("`") for c in schema.split(", ")]
            out = {c: [] for c in names}
            if len(qs) and len(ps):
                x, y = np.stack(qs["vec"].to_numpy()), np.stack(ps["vec"].to_numpy())
                values = np.stack(ps[value].to_numpy()) if ps[value].dtype == object else ps[value].to_numpy()
                ids, all_whole = qs["id"].to_numpy(), qs["whole"].to_numpy(bool)
                near = ps.groupby(["pc", "pq", "pp"], sort=False).indices
                for (cell, *part), asked in qs.groupby(["qc", "qq", "qp"], sort=False).indices.items():
                    at_p = near.get((cell, *part))
                    if at_p is None:
                        continue
                    whole, cut = asked[all_whole[asked]], asked[~all_whole[asked]]
                    found = []
                    if len(whole):
                        total = combine(np.ones((1, len(at_p)), bool), values[at_p])
                        found.append((whole, {c: list(v) * len(whole) for c, v in total.items()}))
                    for s in range(0, len(cut), SLICE):
                        at = cut[s:s + SLICE]
                        sq = np.zeros((len(at), len(at_p)))
                        for j in range(x.shape[1]):
                            sq += (x[at, j, None] - y[None, at_p, j]) ** 2
                        found.append((at, combine(np.sqrt(sq) <= radius, values[at_p])))
                    for at, columns in found:
                        out["id"].extend(ids[at])
                        for c, v in columns.items():
                            out[c].extend(v)
                        if keep:
                            out[keep].extend([cell] * len(at))
            return pd.DataFrame(out if out["id"] else {c: pd.Series([], dtype=object) for c in names})
        if keep:
            schema = f"{schema}, {keep} string"
        dealt = _dealt_groups(sizes, F.col("__nq_rows") * F.col("__np") + F.col("__np_rows") * F.col("__nq"))
        q = q.withColumn("__t", F.pmod(F.xxhash64("qc", "qq", "qp"), F.lit(dealt)))
        p = p.withColumn("__u", F.pmod(F.xxhash64("pc", "pq", "pp"), F.lit(dealt)))
        return q.groupBy("__t").cogroup(p.groupBy("__u")).applyInPandas(block, schema)

    def count(self, queries: DataFrame, weight: str) -> DataFrame:
        """(id, neighbours): the sum of the points' ``weight`` within the radius of each query (id, vec)."""
        import numpy as np
        kind = queries.schema["id"].dataType.simpleString()

        def total(near, values):
            return {"neighbours": near @ values.astype(np.int64)}
        found = self.compare(self.meet(queries, self.cells()), self.points, weight, total, f"id {kind}, neighbours long")
        return found.groupBy("id").agg(F.sum("neighbours").alias("neighbours"))
