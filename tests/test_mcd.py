"""Minimum covariance determinant against plain concentration from many starts."""

import numpy as np
import pytest

from tabwright.operators import anomaly as A


def _rows(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")


def _brute(x, h, starts=400):
    rng, best = np.random.default_rng(7), np.inf
    for _ in range(starts):
        own = x[rng.choice(len(x), 3, replace=False)]
        size = np.inf
        while True:
            z = x - own.mean(0)
            m = (z @ np.linalg.pinv(np.cov(own.T)) * z).sum(1)
            own = x[m <= np.quantile(m, h)]
            new = np.linalg.slogdet(np.cov(own.T))[1]
            if not new < size - 1e-12:
                break
            size = new
        best = min(best, size)
    return best


@pytest.fixture(scope="module")
def masked():
    """A far, tight group of two rows in five, which the plain mean and covariance take for the bulk."""
    rng = np.random.default_rng(3)
    return np.vstack([rng.normal(size=(300, 2)), rng.normal((30, 30), 0.05, (180, 2))])


def test_same_determinant_as_brute_force(spark, masked):
    h = (480 + 3) / 960
    mu, cov = A.mcd_fit(_rows(spark, masked), ["a", "b"])
    assert np.linalg.slogdet(cov)[1] == pytest.approx(_brute(masked, h), abs=0.05)
    assert np.abs(mu).max() < 1


def test_sample_smaller_than_the_table(spark, masked, monkeypatch):
    whole = A.mcd_fit(_rows(spark, masked), ["a", "b"])
    monkeypatch.setattr(A, "MCD_SAMPLE", 150)
    mu, cov = A.mcd_fit(_rows(spark, masked).repartition(7), ["a", "b"])
    assert np.linalg.slogdet(cov)[1] == pytest.approx(np.linalg.slogdet(whole[1])[1], abs=0.05)
    again = A.mcd_fit(_rows(spark, masked), ["a", "b"])
    assert np.allclose(again[0], A.mcd_fit(_rows(spark, masked).repartition(3), ["a", "b"])[0], atol=1e-9)


def test_outliers_score_highest_and_gaps_score_null(spark, masked):
    df = _rows(spark, masked).unionByName(spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0)],
                                                                "id long, a double, b double"))
    got = {r.id: r.score for r in A.mcd(df, ["a", "b"]).collect()}
    assert len(got) == 482 and got[-1] is None and got[-2] is None
    assert min(got[i] for i in range(300, 480)) > max(got[i] for i in range(300))


def test_few_rows(spark):
    assert A.mcd(_rows(spark, np.zeros((0, 2))), ["a", "b"]).collect() == []
    for x in (np.zeros((1, 2)), np.ones((2, 2)), np.ones((9, 2))):
        got = A.mcd(_rows(spark, x), ["a", "b"]).collect()
        assert [r.score for r in got] == [0.0] * len(x)
