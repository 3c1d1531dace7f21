import pytest
from tabwright.functions.names import clean_names
from tabwright.operators import prep, profile, types


def test_nan_is_missing_and_mode(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (3.0, "a")], "x double, s string")
    from tabwright.functions.columns import normalize_nan
    p = {r["column"]: r for r in profile.profile(normalize_nan(df)).collect()}
    assert p["x"]["nulls"] == 2 and p["x"]["non_null"] == 2
    assert p["s"]["mode"] == "a" and p["s"]["mode_count"] == 2 and p["s"]["nulls"] == 1


def test_stats8_bias_corrected(spark):
    vals = [1, 2, 2.5, 7, 11, 30, 30, 2]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = profile.profile(df).first()
    assert r["skewness"] == pytest.approx(1.165401, abs=1e-6)
    assert r["kurtosis"] == pytest.approx(-0.464632, abs=1e-6)
    assert r["median"] == pytest.approx(4.75) and r["q25"] == pytest.approx(2.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_n_no_division_error(spark, n):
    df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
    r = profile.profile(df).first()
    assert r["skewness"] is None or n >= 3
    assert r["kurtosis"] is None


def test_ties_mode_and_median(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (2.0,), (2.0,), (None,)], "x double")
    imp = prep.fit_imputer(df, "mode")
    assert imp.fills["x"] == 2.0
    med = prep.fit_imputer(df, "median")
    assert med.fills["x"] == pytest.approx(3.5)


def test_all_null_fills(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    imp = prep.fit_imputer(df, "mean")
    out = imp.transform(df).collect()
    assert out[0]["s"] == "Unknown" and out[0]["x"] is None


def test_constant_scaling(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    got = {m: prep.scale(df, m).first()["x"] for m in ("zscore", "minmax", "robust", "maxabs")}
    assert got == {"zscore": 0.0, "minmax": 0.0, "robust": 0.0, "maxabs": 1.0}


def test_unknown_scaler(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(ValueError):
        prep.scale(df, "bogus")


def test_clean_names():
    got = clean_names([" A b ", "A-b", "a b", "1x", "é", "__q__", "a_b_1", "a_b"])
    assert got[0] == "a_b" and got[1] == "ab" and got[3] == "col_1x" and got[4] == "col" and got[5] == "q"
    assert len(set(got)) == len(got)


def test_type_advice_bounds(spark):
    df = spark.createDataFrame([(255, -128, 65535, 4294967295, 1e39, "1", "1.5", "2024-01-01")],
                               "a bigint, b bigint, c bigint, d bigint, e double, s1 string, s2 string, s3 string")
    adv = {r["column"]: r["advice"] for r in types.suggest_types(df).collect()}
    assert adv == {"a": "uint8", "b": "int8", "c": "uint16", "d": "uint32", "e": "float64",
                   "s1": "int64", "s2": "float64", "s3": "datetime64[ns]"}


def test_validate_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = profile.validate(df).first()
    assert r["duplicate_rows"] == 1 and r["missing_cells"] == 2 and r["n_rows"] == 3


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from tabwright.functions.quantiles import quantile_dict
    rng = np.random.default_rng(1)
    v = rng.integers(0, 50, size=3000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    q = quantile_dict(df, ["x"], [0.1, 0.5, 0.93])
    for p in (0.1, 0.5, 0.93):
        assert q[("x", p)] == pytest.approx(float(np.quantile(v, p)))


def test_brackets_are_narrowed_and_widened(spark, monkeypatch):
    import numpy as np
    from tabwright.functions import quantiles as Q
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=5000), 4)
    v[:1700] = 0.0  # a hot value holding a third of the rows
    w = rng.integers(-3, 3, size=5000) * 1e15
    rows = [(float(a), None if i % 11 == 0 else float(b), 7.0, None) for i, (a, b) in enumerate(zip(v, w, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, same double, none double").repartition(7)
    probs = [0.0, 0.05, 0.33, 0.5, 0.99, 1.0]
    y = np.array([r[1] for r in rows if r[1] is not None])
    for sketch, inside in ((10_000, 4_000_000), (20, 4_000_000), (20, 50), (500, 3)):
        monkeypatch.setattr(Q, "SKETCH", sketch)
        monkeypatch.setattr(Q, "INSIDE", inside)
        got = Q.quantile_dict(df, df.columns, probs)
        assert set(got) == {(c, p) for c in ("x", "y", "same") for p in probs}
        for c, values in (("x", v), ("y", y), ("same", np.full(5000, 7.0))):
            for p in probs:
                assert got[c, p] == pytest.approx(float(np.quantile(values, p))), (sketch, inside, c, p)
    assert Q.quantile_dict(df.limit(0), ["x"], [0.5]) == {}


def test_describe_and_unique_counts_by_type(spark):
    from decimal import Decimal
    big = 2**53
    df = spark.createDataFrame([(big, Decimal("1.10"), 0.5, 1), (big + 1, Decimal("1.1"), None, 1), (None, None, 0.5, 2)],
                               "a long, b decimal(10,2), c double, d int")
    p = {r["column"]: r["n_unique"] for r in profile.profile(df).collect()}
    assert p == {"a": 2, "b": 1, "c": 1, "d": 2}
    d = {r["column"]: (r["count"], r["p50"]) for r in profile.describe_numeric(df).collect()}
    assert d["d"] == (3, 1.0) and d["c"] == (2, 0.5)
