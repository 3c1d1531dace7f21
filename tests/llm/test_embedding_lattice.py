"""E8 lattice hashing against all pairs."""

import numpy as np
import pytest

from tabwright.llm import embedding_lattice as L

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    """vec_id -> (n_links, component_id) by comparing everything (unique ids)."""
    ok = [(i, np.array(e, float), k) for i, e, k in rows
          if k is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    near = {i: set() for i, _, _ in rows}
    for a, (i, x, k) in enumerate(ok):
        for j, y, m in ok[a + 1:]:
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_decoder_finds_the_nearest_point():
    x = np.random.default_rng(1).uniform(-3, 3, (500, 8))
    c = L.decode_e8(x)
    around = np.vstack([np.zeros((1, 8), int), L._roots(4)])
    assert len(around) == 2401
    assert (((x[:, None] - (c[:, None] + around[None]) / 2) ** 2).sum(2).argmin(1) == 0).all()


@pytest.mark.parametrize("dim", [5, 16])
def test_every_pair_and_no_other(spark, dim):
    """Pairs close to the threshold on both sides, a large group of near copies, blocks smaller than the group."""
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((60, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((60, dim))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.90, 0.96, (60, 1)))
    hot = base[0] + 0.08 * rng.standard_normal((40, dim)) / np.sqrt(dim)
    v = np.vstack([base, np.cos(angle) * base + np.sin(angle) * side, hot]) * rng.uniform(0.5, 5, (160, 1))
    rows = [(i, v[i].astype(np.float32).tolist(), int(i % 60 % 3)) for i in range(160)]
    df = spark.createDataFrame(rows, SCHEMA)
    expect = brute(rows)
    assert result(L.near_duplicates(df)) == expect
    assert result(L.near_duplicates(df, block_rows=7)) == expect
    assert sum(n for n, _ in expect.values()) > 100


def test_odd_rows(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 1), (2, e, 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
            (8, [1.0, None, 3.0], 1), (9, [float("nan"), 2.0, 3.0], 1), (10, [float("inf"), 2.0, 3.0], 1),
            (11, [1.0, 2.0], 1), (12, [2.0, 4.0, 6.0], 1), (13, [-0.0, 1.0, 0.0], 1), (14, [0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", n_links string, kept int")
    got = L.near_duplicates(df)
    assert result(got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())
    none = L.near_duplicates(df.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]
    again = L.near_duplicates(spark.createDataFrame([(1, e, 1), (1, e, 1), (None, e, 1)], SCHEMA)).collect()
    assert [(r.n_links, r.component_id) for r in again] == [(2, 1)] * 3


def test_extreme_magnitudes(spark):
    """Finite components whose squares overflow or vanish link like any others."""
    rows = [(1, [1e200, 2e200, 3e200], 1), (2, [1e-200, 2.001e-200, 3e-200], 1), (3, [1.0, 2.0, 3.0], 1),
            (4, [1e300, -2e300, 1e300], 1), (5, [5e-324, -1e-323, 5e-324], 1), (6, [1e308, 1e-308, 0.0], 1)]
    got = L.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}
