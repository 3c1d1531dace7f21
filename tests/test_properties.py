"""Property tests for the driver-side helpers (no Spark needed)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwright.functions.names import clean_name, clean_names
from tabwright.models.linear import lars, lasso_cd, ols
from tabwright.operators.sample import largest_remainder


@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_clean_names_unique_and_valid(names):
    out = clean_names(names)
    assert len(out) == len(names) and len(set(out)) == len(out)
    for n in out:
        assert n and not n[0].isdigit() and all(ch.isalnum() or ch == "_" for ch in n)
        assert n.isascii()


@given(st.text(max_size=20))
def test_clean_name_idempotent(name):
    assert clean_name(clean_name(name)) == clean_name(name)


@given(st.dictionaries(st.integers(0, 20).map(lambda i: (f"c{i}",)), st.integers(1, 10_000), min_size=1, max_size=20),
       st.floats(0.0, 1.0))
@settings(max_examples=200, deadline=None)
def test_largest_remainder_hits_total_and_bounds(counts, share):
    total = int(sum(counts.values()) * share)
    q = largest_remainder(counts, total)
    assert sum(q.values()) == total
    n = sum(counts.values())
    for g, c in counts.items():
        assert 0 <= q[g] <= c and abs(q[g] - c * total / n) < 1.0 + 1e-9


@given(st.integers(2, 6), st.integers(0, 10_000))
@settings(max_examples=50, deadline=None)
def test_full_lars_path_equals_ols_and_zero_penalty_lasso(d, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(200, d))
    y = X @ rng.normal(size=d) + 0.1 * rng.normal(size=200)
    Xc, yc = X - X.mean(0), y - y.mean()
    G, c = Xc.T @ Xc, Xc.T @ yc
    b = ols(G, c)
    assert np.allclose(lars(G, c), b, atol=1e-6)
    assert np.allclose(lasso_cd(G, c, 200, 0.0, iters=5000, tol=1e-14), b, atol=1e-5)


def test_columns_of_a_kind_with_the_target_last(spark):
    from tabwright.functions.columns import select_kinds
    df = spark.createDataFrame([(1, "a", 2.0, True)], "y int, s string, x double, b boolean")
    assert select_kinds(df, "numeric", "y").columns == ["x", "y"]
    assert select_kinds(df, ["categorical", "boolean"], "y").columns == ["s", "b", "y"]
    assert select_kinds(df).columns == ["y", "s", "x", "b"]


def test_own_models_and_steps(spark):
    from dataclasses import dataclass

    import pytest

    from tabwright.models import catalog
    from tabwright.models.base import Fitted, Model
    from tabwright.operators import prep

    @dataclass
    class Mean(Model):
        def fit(self, df, features, label=None):
            m = df.agg(F.avg(label)).first()[0]

            class At(Fitted):
                def transform(self, df):
                    return df.withColumn("prediction", F.lit(m))
            return At()

    from pyspark.sql import functions as F
    catalog.register_model(Mean("mean", "regression", "Mean of the target"))
    try:
        df = spark.range(5).withColumn("y", F.col("id") * 2.0)
        assert catalog.get_model("regression", "mean").fit(df, ["id"], "y").transform(df).first()["prediction"] == 4.0
        assert "mean" in catalog.available_models("regression")
        assert catalog.catalogue(spark).where("model = 'mean'").count() == 1
    finally:
        catalog._REGISTERED.clear()
    prep.register_step("double", lambda df, column: df.withColumn(column, F.col(column) * 2))
    assert prep.apply_step(spark.range(3), "double", column="id").agg(F.sum("id")).first()[0] == 6
    with pytest.raises(ValueError):
        prep.apply_step(df, "nothing")
