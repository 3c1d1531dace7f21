"""Affinity propagation over all pairs against a plain dense version."""

import numpy as np
import pytest

from tabwright.models import affinity as A
from tabwright.models import cluster as C


def plain_exemplars(x, rounds, damping):
    n = len(x)
    s = -((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(s, np.median(s[np.triu_indices(n, 1)]))
    r, a, k = np.zeros((n, n)), np.zeros((n, n)), np.arange(n)
    for _ in range(rounds):
        v = a + s
        best = np.array([[v[i, np.arange(n) != j].max() for j in range(n)] for i in range(n)])
        r = damping * r + (1 - damping) * (s - best)
        p = np.maximum(r, 0.0)
        np.fill_diagonal(p, 0.0)
        new = np.minimum(0.0, r[k, k][None, :] + p.sum(0)[None, :] - p)
        new[k, k] = p.sum(0)
        a = damping * a + (1 - damping) * new
    return np.flatnonzero((r + a)[k, k] > 0)


def plain_labels(x, ids, rounds, damping=0.5):
    ex = plain_exemplars(x, rounds, damping)
    ex = ex[np.argsort([ids[e] for e in ex])]
    return {ids[i]: int(((x[ex] - x[i]) ** 2).sum(-1).argmin()) for i in range(len(x))}


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(c, 0.6, (50, 2)) for c in (0.0, 3.0, 7.0)])


@pytest.mark.parametrize("whole", [2048, 10])  # 10: rounds as Spark jobs over pairs of blocks
def test_all_rows_are_candidates(spark, places, whole, monkeypatch):
    monkeypatch.setattr(A, "WHOLE", whole)
    monkeypatch.setattr(A, "BLOCK_ROWS", 70)
    rounds = 50 if whole > 10 else 6
    ids = [int(i * 7 % 1009) for i in range(len(places))]
    rows = [(i, float(a), float(b)) for i, (a, b) in zip(ids, places)]
    df = spark.createDataFrame(rows + [(2001, None, 1.0), (None, 0.0, 0.0)], "id long, a double, b double").repartition(3)
    got = [tuple(r) for r in C.affinity_propagation(df.where("id is not null"), ["a", "b"], "id", rounds=rounds).collect()]
    assert len(got) == len(rows) + 1
    assert dict(got) == plain_labels(places, ids, rounds) | {2001: None}


def test_rows_without_id_and_single_rows(spark):
    df = spark.createDataFrame([(5, 1.0), (None, 2.0), (6, None)], "id long, x double")
    got = {r["id"]: r["cluster"] for r in C.affinity_propagation(df, ["x"], "id").collect()}
    assert got == {5: 0, None: -1, 6: None}


@pytest.mark.parametrize("few", [200_000, 5])  # 5: a histogram inside a histogram
def test_median_of_all_pairs(spark, places, few, monkeypatch):
    monkeypatch.setattr(A, "FEW", few)
    monkeypatch.setattr(A, "BINS", 64)
    for n in (149, 150):
        x = np.round(places[:n], 1)  # many equal distances
        points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "idx long, vec array<double>")
        sq = ((x[:, None] - x[None]) ** 2).sum(-1)[np.triu_indices(n, 1)]
        assert A.median_sq(points, n) == np.median(sq)


def test_boxes_left_out_change_nothing(places):
    """A round's kernels over one block with small boxes and with one box."""
    import pandas as pd
    n, rng = len(places), np.random.default_rng(0)
    b, gap, c = -rng.uniform(0, 2, (n, 4)), rng.uniform(0, 0.2, (n, 4)), rng.uniform(-3, 1, (n, 4))
    frame = pd.DataFrame({"idx": np.arange(n), "vec": list(places), "b": list(b), "gap": list(gap),
                          "top": list(rng.integers(0, n, (n, 4))), "own": -1.0, "c": list(c)})
    found = []
    for size in (4, 1000):
        A.SUB_ROWS, A.SUB_COLS, kept = size, size, (A.SUB_ROWS, A.SUB_COLS)
        try:
            found.append((A._two_largest(frame, frame, 0.5, True).sort_values("idx").to_numpy(),
                          A._positive_sums(frame, frame, 0.5, -2.0, True).sort_values("idx").to_numpy()))
        finally:
            A.SUB_ROWS, A.SUB_COLS = kept
    for small, one in zip(*found):
        np.testing.assert_allclose(small, one, atol=1e-12)
