"""Fingerprints bit by bit, groups against all pairs."""

import re

import numpy as np
import xxhash

from tabwright.llm import simhash_vptree as S
from tabwright.llm.common import connected_components


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, bits=2):
    """fp -> smallest fp (as a signed number) of its group, by all pairs."""
    out = {int(p): int(p) for p in prints}
    signed = lambda p: int(np.uint64(p).astype(np.int64))
    label = {p: signed(p) for p in out}
    changed = True
    while changed:
        changed = False
        for p in out:
            low = min(label[q] for q in out if (p ^ q).bit_count() <= bits)
            if low < label[p]:
                label[p], changed = low, True
    return {signed(p): v for p, v in label.items()}


def test_fingerprints():
    rng = np.random.default_rng(0)
    texts = [None, "", " \t\n", "one", "One  two", "É é x y", "a b c", "a\x0bb\x0cc d", "x " * 900,
             " ".join(map(str, rng.integers(0, 40, 3000)))]
    assert [S.simhash(t) for t in texts] == [plain(t) for t in texts]


def test_groups_equal_all_pairs(spark):
    """Chains, a dense ball larger than a leaf, far points; upper tree with several shards."""
    rng = np.random.default_rng(3)
    flip = lambda p, n: p ^ int(sum(1 << int(b) for b in rng.choice(64, n, False)))
    base = [int(x) for x in rng.integers(0, 2**64, 300, dtype=np.uint64)]
    prints = set(base)
    for p in base[:100]:
        for n in (1, 2, 3):
            p = flip(p, n)
            prints.add(p)
    prints |= {flip(base[0], 2) for _ in range(400)}
    rows = [int(np.uint64(p).astype(np.int64)) for p in sorted(prints)]
    df = spark.createDataFrame([(r,) for r in rows], "fp long")
    old, S.SHARD_ROWS, leaf, S.LEAF = S.SHARD_ROWS, 64, S.LEAF, 16
    try:
        got = {r.fp: r.component for r in S.hamming_components(df).collect()}
    finally:
        S.SHARD_ROWS, S.LEAF = old, leaf
    assert got == groups(prints)


def test_dense_points_by_lookup():
    rng = np.random.default_rng(4)
    p = np.unique(np.array([int(sum(1 << int(b) for b in rng.choice(10, rng.integers(0, 6), False)))
                            for _ in range(3000)], np.uint64))
    old, S.LEAF = S.LEAF, 8
    try:
        a, b = S._spanning(p, 2)
    finally:
        S.LEAF = old
    want = groups(p.tolist())
    root = {int(x): int(x) for x in p}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        root[y] = x
    for x in root:
        while root[root[x]] != root[x]:
            root[x] = root[root[x]]
    same = {}
    for x in root:
        same.setdefault(want[int(np.uint64(x).astype(np.int64))], set()).add(root[x])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(root.values()))


def test_odd_rows(spark):
    t = "a b c d e f"
    rows = [(3, t), (3, t), (5, t), (None, t), (7, None), (9, ""), (8, " "), (4, "other words stand here"), (None, "alone in the group")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, kept int")
    got = sorted((r.component_id is None, r.component_id or 0, r.doc_id is None, r.doc_id or 0, r.kept)
                 for r in S.near_duplicates(df).collect())
    assert got == [(False, 3, False, 3, True), (False, 3, False, 3, True), (False, 3, False, 5, False),
                   (False, 3, True, 0, False), (False, 4, False, 4, True), (False, 7, False, 7, True),
                   (False, 7, False, 8, False), (False, 7, False, 9, False), (True, 0, True, 0, True)]
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    e = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (5000, 4500), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)} | {4000: 4000, 4500: 4000, 5000: 4000}
    assert got == want
