"""Embedding near-duplicates by E8 lattice hashing: every pair above a cosine is met, no other is linked.

Unit vectors with cosine >= c differ by at most r = sqrt(2 - 2c). A random rotation (a fixed seed) is cut into
blocks of eight dimensions, one hash table each, m tables in all: in at least one of them the projections of a
pair differ by at most t = r / sqrt(m). Their midpoint then lies within t / 2 of both, so each vector is filed
under the lattice cell that its projection decodes to and under every neighbouring cell that its ball of radius
t / 2 touches; the pair meets in the midpoint's cell. This is exact: no pair is lost to chance.

A pair may meet in several cells. It counts only in the first table where its projections are within t, and
there in its midpoint's cell, so counts need no pair list: a task compares a cell's vectors in blocks, verifies
cosines in double precision, and returns link counts per vector and edges that span the same groups.
Equal vectors are one before hashing. Cells with many vectors are dealt in blocks to many tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import connected_components, cut_lineage, written

CELL = 0.3          # least lattice scale, for unit vectors
BLOCK_ROWS = 2048   # vectors of one cell that a task holds on either side
BROADCAST_CELLS = 100_000  # cells with more vectors than that which may be broadcast; else they are joined


def _roots(limit: int) -> np.ndarray:
    """E8 vectors of squared length up to ``limit`` (an even number), the origin left out, doubled to integers."""
    out = []
    for half in (0, 1):  # all coordinates integral, or all halves of odd numbers
        def grow(prefix, left):
            if len(prefix) == 8:
                if sum(prefix) % 4 == 0:
                    out.append(prefix)
                return
            top = int(np.sqrt(left))
            for v in range(-top, top + 1):
                if v % 2 == half:
                    grow((*prefix, v), left - v * v)
        grow((), 4 * limit)
    v = np.array(out, np.int64)
    return v[(v != 0).any(1)]


def unit(e: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square overflows or vanishes."""
    e = e / np.abs(e).max(axis=1, keepdims=True)
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of every row, doubled to integers: the better of the nearest points of D8 and D8 + 1/2."""
    def d8(y):
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(1)
        odd = near.sum(1) % 2 != 0
        rows = np.flatnonzero(odd)
        w = worst[rows]
        near[rows, w] += np.where(off[rows, w] >= 0, 1, -1)
        return near

    a = d8(x)
    b = d8(x - 0.5) + 0.5
    pick = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(pick[:, None], a, b)).astype(np.int64)


class Lattice:
    """Tables for vectors of ``dim`` components: rotation, probe radius, neighbours."""

    def __init__(self, dim: int, cosine: float, cell: float, seed: int = 0):
        self.cosine = cosine
        self.padded = -(-dim // 8) * 8
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.standard_normal((self.padded, self.padded)))
        self.rotation = (q * np.sign(np.diag(r)))[:dim]
        self.tables = self.padded // 8
        # a little more than needed, for rounding
        self.radius = np.sqrt(max(0.0, 2 - 2 * cosine) / self.tables) * (1 + 1e-9) + 1e-9
        self.cell = max(cell, 2.3 * self.radius)  # in smaller cells a ball touches more than the next ones
        ball = self.radius / 2 / self.cell
        limit = 4  # neighbours whose border can be that near: |v| / 2 - covering radius 1 <= ball
        while np.sqrt(limit + 2) / 2 - 1 <= ball:
            limit += 2
        self.near = _roots(limit)
        self.length = np.sqrt((self.near ** 2).sum(1)) / 2

    def project(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 8) projections in units of the cell."""
        return (unit @ self.rotation).reshape(len(unit), self.tables, 8) / self.cell

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, doubled lattice point) for every cell that a ball of half the radius around a row touches.

        A cell is kept if the border between it and the row's own cell is within that ball, which holds for
        every cell that the ball really touches.
        """
        home = decode_e8(x)
        off = x - home / 2
        # |off - v|^2 - |off|^2 <= 2 * ball * |v|, v = near / 2
        border = self.length ** 2 - off @ self.near.T
        row, k = np.nonzero(border <= 2 * (self.radius / 2 / self.cell) * self.length + 1e-9)
        rows = np.concatenate([np.arange(len(x)), row])
        return rows, np.concatenate([home, home[row] + self.near[k]])


def _key(table: int, cells: np.ndarray) -> np.ndarray:
    """64-bit name of a cell; equal names of two cells only add comparisons."""
    h = np.full(len(cells), 0x9E3779B97F4A7C15 + table, np.uint64)
    for j in range(8):
        h = (h ^ cells[:, j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _links(lat: Lattice, table: int, key: int, x: np.ndarray, y: np.ndarray | None):
    """Index pairs (i < j when y is None) at the cosine whose home is this cell."""
    other = x if y is None else y
    i, j = np.nonzero(x @ other.T >= lat.cosine - 1e-9)
    if y is None:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    keep = np.zeros(len(i), bool)
    px, py = lat.project(x), lat.project(other)
    for lo in range(0, len(i), 200_000):  # exact cosine and home, some pairs at a time
        a, b = i[lo:lo + 200_000], j[lo:lo + 200_000]
        ok = np.einsum("ij,ij->i", x[a], other[b]) >= lat.cosine
        first = (((px[a] - py[b]) * lat.cell) ** 2).sum(2) <= lat.radius ** 2
        ok &= first.argmax(1) == table
        mid = decode_e8((px[a, table] + py[b, table]) / 2)
        keep[lo:lo + 200_000] = ok & (_key(table, mid) == key)
    return i[keep], j[keep]


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of the group of each of n points, for links i-j."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, cell: float = CELL,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Link vectors (vec_id, embedding array, label) of equal, non-null labels at ``cosine`` or more.

    Returns a row per input row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    of the group, its own if it has no link), kept (vec_id = component_id). Vectors that are null, empty, zero or
    hold a null or non-finite component, and vectors with a null label, have no link. Vectors of different
    lengths have no link. vec_ids should be unique; a repeated row counts as another vector, a row with a null
    vec_id links like any other. Other columns are not read.
    """
    e = F.col("embedding").cast("array<double>")
    sound = (F.col("label").isNotNull() & e.isNotNull() & F.coalesce(
        F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v)
                                                 & (F.abs(v) < float("inf"))), F.lit(False)))
    rows = vectors.select("vec_id", "label", e.alias("e"), sound.alias("sound"))
    plain = F.transform("e", lambda v: v + F.lit(0.0))  # no minus zero
    own = written(rows.select("vec_id", "sound", "label", F.when(F.col("sound"), plain).alias("e"))
                  .withColumn("h", F.when(F.col("sound"), F.xxhash64("label", "e"))), "vectors")
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    packed = "<f4" if single else "<f8"

    @F.pandas_udf("binary")
    def pack(e: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, packed).tobytes() for v in e], dtype=object)

    distinct = written(own.where("sound").groupBy("label", "h", "e").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn(
        "node", F.monotonically_increasing_id()).withColumn("v", pack("e")), "distinct-vectors")
    dims = [r[0] for r in distinct.select(F.size("e").alias("d")).distinct().orderBy("d").collect()]
    parts = [_component(distinct.where(F.size("e") == d), d, cosine, cell, block_rows, packed) for d in dims]
    counts, edges = None, None
    for c, g in parts:
        counts = c if counts is None else counts.unionByName(c)
        edges = g if edges is None else edges.unionByName(g)
    if counts is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.lit(True).alias("kept"))
    groups = connected_components(edges)
    named = (distinct.select("node", "label", "h", "e", "least", "copies")
             .join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
             .join(counts, "node", "left"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_vector = cut_lineage(named.join(least, "component").select(
        "label", "h", "e", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    return (own.join(by_vector, ["label", "h", "e"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("sound"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _component(distinct: DataFrame, dim: int, cosine: float, cell: float, block_rows: int, packed: str):
    """(node, links) and edges (a, b) of the distinct vectors of one length."""
    lat = Lattice(dim, cosine, cell)

    def hashes(with_vectors):
        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                label, node, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
                raw = batch.column(3).to_pylist()
                e = np.frombuffer(b"".join(raw), packed).reshape(len(batch), dim).astype(np.float64)
                x = lat.project(unit(e))
                for t, lo in itertools.product(range(lat.tables), range(0, len(x), 512)):
                    row, cells = lat.cells(x[lo:lo + 512, t])
                    row = row + lo
                    cols = [pa.array(label[row]), pa.array(np.full(len(row), t, np.int32)), pa.array(_key(t, cells))]
                    names = ["label", "t", "cell"]
                    if with_vectors:
                        cols += [pa.array(node[row]), pa.array(copies[row]),
                                 pa.array([raw[i] for i in row.tolist()], pa.binary())]
                        names += ["node", "copies", "v"]
                    yield pa.RecordBatch.from_arrays(cols, names)
        return run

    label_type = distinct.schema["label"].dataType.simpleString()
    cell_type = f"label {label_type}, t int, cell long"
    plain = distinct.select("label", "node", "copies", "v")
    crowded = cut_lineage(plain.mapInArrow(hashes(False), cell_type).groupBy("label", "t", "cell")
                          .agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
                          .select("label", "t", "cell", F.ceil(F.col("n") / block_rows).alias("blocks")))
    few = crowded.count() <= BROADCAST_CELLS
    # every pair of blocks of a cell is a group of its own: a row goes to each pair that its block is in
    dealt = (plain.mapInArrow(hashes(True), f"{cell_type}, node long, copies long, v binary")
             .join(F.broadcast(crowded) if few else crowded, ["label", "t", "cell"], "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
             .withColumn("b", F.pmod(F.xxhash64("node"), "blocks"))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("label", "t", "cell", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b",
                     "node", "copies", "v"))
    group = ["label", "t", "cell", "b1", "b2"]

    def compare(t, key, b1, b2, b, node, copies, raw):
        e = np.frombuffer(b"".join(raw), packed).reshape(len(node), dim).astype(np.float64)
        x = unit(e)
        if b1 == b2:
            i, j = _links(lat, t, key, x, None)
        else:
            left, right = np.flatnonzero(b == b1), np.flatnonzero(b == b2)
            i, j = _links(lat, t, key, x[left], x[right])
            i, j = left[i], right[j]
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        some = np.flatnonzero(links)
        return node[some], links[some].astype(np.int64), node[_spanning(len(node), i, j)[some]]

    def groups(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not len(batch):
                    continue
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables(
                    [held, pa.Table.from_batches([batch])])
            if held is None:
                return
            cols = [held.column(k).to_numpy() for k in range(8)]
            edge = np.zeros(len(held), bool)
            for k in range(5):
                edge[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = np.concatenate([[0], np.flatnonzero(edge), [len(held)]])
            if batch is not None:
                cuts = cuts[:-1]  # the last group may go on in the next batch
            out = []
            raws = held.column(8).to_pylist() if len(cuts) > 1 else []
            for lo, hi in itertools.pairwise(cuts.tolist()):
                if hi - lo > 1:
                    out.append(compare(int(cols[1][lo]), cols[2][lo], cols[3][lo], cols[4][lo], cols[5][lo:hi],
                                       cols[6][lo:hi], cols[7][lo:hi], raws[lo:hi]))
            out = [o for o in out if o is not None]
            held = held.slice(int(cuts[-1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 ["node", "links", "other"])
            if batch is None:
                return

    found = cut_lineage(dealt.repartition(*group).sortWithinPartitions(*group, "node")
                        .mapInArrow(groups, "node long, links long, other long")
                        .groupBy("node", "other").agg(F.sum("links").alias("links")))
    return (found.groupBy("node").agg(F.sum("links").alias("links")),
            found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
