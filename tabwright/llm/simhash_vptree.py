"""SimHash near-duplicates: fingerprints of word shingles, linked at a few differing bits by vantage-point trees.

A tree over Hamming distance cuts the distinct fingerprints at a vantage point: inside (distance at most the
median) and outside. Two fingerprints within r bits have a midpoint within ceil(r / 2) of both, so by the
triangle inequality it is enough that a fingerprint goes to every side that its ball of that radius touches: the
pair then meets on the midpoint's side. The upper tree, of bounded size, is drawn from a bounded sample and only
routes; every fingerprint is dealt to the shards whose boundary its ball overlaps. Inside a shard the tree goes
on, and the leaves compare all pairs exactly. Links leave a shard as edges that span the same groups (at most one
per fingerprint and leaf), never as all pairs of a group.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import connected_components, cut_lineage, written

SHARD_ROWS = 4096  # distinct fingerprints aimed at per shard
MAX_DEPTH = 12     # of the upper tree: at most 4,096 shards, each of which goes on by itself
SAMPLE = 1 << 16   # fingerprints that the upper tree is drawn from
LEAF = 256
_BYTES = np.uint64(0x0101010101010101)


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit fingerprint: a bit is set if over half the shingles' XXH64 have it (no word: zero).

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``words`` words joined
    by a space and count as often as they occur; a shorter text is one shingle.
    """
    import xxhash
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    buf = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(w) - words + 1
    parts = map(buf.__getitem__, map(slice, starts[:n].tolist(), ends[words - 1:].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)
    cuts = np.arange(0, n, 255)  # 255 hashes at most fill a byte of the sums
    print_ = 0
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _BYTES, cuts)
        counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > n).tolist():
            print_ |= 1 << (8 * byte + k)
    return print_


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """``simhash`` of a text column as a signed 64-bit long."""
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((simhash(t, words, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return prints(text)


def _split(points: np.ndarray, reach: int, rng) -> tuple[np.uint64, int] | None:
    """A vantage point and median distance that cut the points well; None where none does."""
    best, choice = 1.6 * len(points), None
    for v in points[rng.integers(0, len(points), 4)]:
        d = np.bitwise_count(points ^ v)
        median = int(np.median(d))
        both = int((d <= median + reach).sum() + (d > median - reach).sum())
        if both < best and (d <= median + reach).sum() < len(points):
            best, choice = both, (v, median)
    return choice


def _upper_tree(sample: np.ndarray, depth: int, reach: int) -> list[tuple]:
    """Nodes (vantage, median, inside, outside); a negative child -s-1 is shard s."""
    nodes, shards = [], 0
    rng = np.random.default_rng(0)

    def grow(points, level):
        nonlocal shards
        cut = _split(points, reach, rng) if level < depth and len(points) >= 8 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(points ^ cut[0])
        nodes[at] = (*cut, grow(points[d <= cut[1]], level + 1), grow(points[d > cut[1]], level + 1))
        return at

    grow(sample, 0)
    return nodes


def _route(prints: np.ndarray, nodes: list[tuple], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) for every shard that a fingerprint's ball touches."""
    if not nodes:
        return np.arange(len(prints)), np.zeros(len(prints), np.int64)
    rows, shards, open_ = [], [], [(0, np.arange(len(prints)))]
    while open_:
        at, idx = open_.pop()
        vantage, median, inside, outside = nodes[at]
        d = np.bitwise_count(prints[idx] ^ vantage).astype(np.int64)
        for child, part in ((inside, idx[d <= median + reach]), (outside, idx[d > median - reach])):
            if child < 0:
                rows.append(part)
                shards.append(np.full(len(part), -child - 1))
            elif len(part):
                open_.append((child, part))
    return np.concatenate(rows), np.concatenate(shards)


def _spanning(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the points just as all pairs within ``bits`` do (each point with its group's first)."""
    n = len(points)
    label = np.arange(n)
    if n > 4 * LEAF:  # too dense for the tree: look every neighbour up
        order = np.argsort(points)
        ranked = points[order]
        one = [np.uint64(1) << np.uint64(i) for i in range(64)]
        flips = [np.bitwise_or.reduce(c) for b in range(1, bits + 1) for c in combinations(one, b)]
        changed = True
        while changed:
            before = label.copy()
            for f in flips:
                at = np.minimum(np.searchsorted(ranked, points ^ f), n - 1)
                i = np.flatnonzero(ranked[at] == points ^ f)
                j = order[at[i]]
                np.minimum.at(label, i, label[j])
            label = label[label]
            changed = not np.array_equal(before, label)
    else:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= bits
        if near.sum() > n:
            while True:
                low = np.where(near, label[None, :], n).min(1)
                low = low[low]
                if np.array_equal(low, label):
                    break
                label = low
    i = np.flatnonzero(label != np.arange(n))
    return points[label[i]], points[i]


def _shard_edges(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    reach, rng = -(-bits // 2), np.random.default_rng(0)
    a, b, open_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [points]
    while open_:
        p = open_.pop()
        cut = _split(p, reach, rng) if len(p) > LEAF else None
        if cut is None:
            x, y = _spanning(p, bits)
            a.append(x)
            b.append(y)
        else:
            d = np.bitwise_count(p ^ cut[0]).astype(np.int64)
            open_ += [p[d <= cut[1] + reach], p[d > cut[1] - reach]]
    return np.concatenate(a), np.concatenate(b)


def hamming_components(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Distinct fingerprints (column ``fp`` long, no null) -> (fp, component): groups linked at ``bits`` or fewer.

    Every fingerprint is returned; a component is named by its smallest fingerprint.
    """
    n = prints.count()
    reach = -(-bits // 2)
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / SHARD_ROWS))))))
    nodes = []
    if depth:
        sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, 64 << depth)).toPandas()["fp"]
        nodes = _upper_tree(sample.to_numpy(np.int64).view(np.uint64), depth, reach)

    def route(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            rows, shards = _route(fp.view(np.uint64), nodes, reach)
            yield pd.DataFrame({"shard": shards, "fp": fp[rows]})

    def link(pdf):
        a, b = _shard_edges(pdf["fp"].to_numpy(np.int64).view(np.uint64), bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    edges = cut_lineage(prints.select("fp").mapInPandas(route, "shard long, fp long")
                        .groupBy("shard").applyInPandas(link, "a long, b long").distinct())
    found = connected_components(edges).withColumnRenamed("node", "fp")
    return prints.select("fp").join(found, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """Group the documents (doc_id, text) whose SimHash differs in at most ``bits`` bits, directly or in steps.

    Returns a row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    group; null if all are null), kept (whether the row has that doc_id), fp (the fingerprint as a long), group (the group's
    smallest fingerprint as a long).
    Null and empty texts have fingerprint zero and link like any other; copies share a fingerprint and meet only
    in a map-side combined minimum; a repeated row is returned as often as it comes. Other columns are not read.
    """
    own = written(docs.select("doc_id", fingerprint(F.col("text").cast("string"), words, seed).alias("fp")),
                  "simhash")
    prints = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = hamming_components(prints, bits)
    named = prints.join(groups, "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = cut_lineage(named.join(least, "component").select("fp", "component_id", F.col("component").alias("group")))
    return own.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "fp", "group")
