"""Imputation and scaling as fitted constants + column expressions.

Fitting is one aggregate (plus the distributed quantile / frequency tables
where medians or modes are needed); the constants - one per column - come back
to the driver and the transform is a single projection (``coalesce`` /
arithmetic with literals), so applying it needs no shuffle and also works on a
streaming DataFrame. ``avg(x) over ()`` is never used: it would move every row
into one partition.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import columns_of
from tabwright.functions.quantiles import quantile_dict
from tabwright.operators.profile import _mode, numeric_frequencies, string_frequencies

IMPUTE_METHODS = ("mean", "median", "mode", "knn", "iterative")
SCALE_METHODS = ("zscore", "minmax", "robust", "maxabs")
UNKNOWN = "Unknown"  # fixed value: fill for an all-missing string column


def modes(df: DataFrame, num: list[str], strs: list[str]) -> dict[str, object]:
    """Most frequent value per column (ties -> smallest), from the frequency tables."""
    out: dict[str, object] = {}
    if num:
        for r in _mode(numeric_frequencies(df, num)).collect():
            # integers stay integers: a double can't hold all of them
            whole = isinstance(df.schema[r["column"]].dataType, T.IntegralType)
            out[r["column"]] = None if r["mode"] is None else int(float(r["mode"])) if whole and "." in r["mode"] \
                else int(r["mode"]) if whole else float(r["mode"])
    if strs:
        for r in _mode(string_frequencies(df, strs)).collect():
            out[r["column"]] = r["mode"]
    return out


_STEPS: dict[str, object] = {}


def register_step(name: str, step) -> None:
    """Add a preparation step of one's own: ``step(df, **options) -> DataFrame``."""
    if not callable(step):
        raise ValueError("a step is a function of a DataFrame")
    _STEPS[name] = step


def apply_step(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in _STEPS:
        raise ValueError(f"unknown preparation step {name!r}")
    return _STEPS[name](df, **options)


@dataclass
class FittedImputer:
    method: str
    fills: dict[str, object] = field(default_factory=dict)
    to_double: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = []
        for c in df.columns:
            x = F.col(c)
            if c in self.to_double:
                x = x.cast("double")
            if c in self.fills and self.fills[c] is not None:
                x = F.coalesce(x, F.lit(self.fills[c]).cast(df.schema[c].dataType if c not in self.to_double else "double"))
            cols.append(x.alias(c))
        return df.select(*cols)


def fit_imputer(df: DataFrame, method: str = "mean", exclude: list[str] = ()) -> FittedImputer:
    """mean / median: numeric columns (to double) and string columns with their mode; mode: every column."""
    exclude = list(exclude)
    num = columns_of(df, "numeric", exclude)
    strs = columns_of(df, "categorical", exclude)
    if method in ("mean", "median"):
        fills: dict[str, object] = {}
        if num and method == "mean":
            r = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in num]).first()
            fills.update({c: r[c] for c in num})
        elif num:
            q = quantile_dict(df, num, [0.5])
            fills.update({c: q.get((c, 0.5)) for c in num})
        m = modes(df, [], strs)
        fills.update({c: m.get(c, UNKNOWN) for c in strs})
        return FittedImputer(method, fills, num)
    if method == "mode":
        others = [c for c in df.columns if c not in exclude and c not in num and c not in strs]
        m = modes(df, num, strs + others)
        fills = {c: m.get(c) for c in num + others}
        fills.update({c: m.get(c, UNKNOWN) for c in strs})
        # non-string, non-numeric modes come back as text: cast back on apply
        return FittedImputer(method, fills, [])
    if method in ("knn", "iterative"):
        raise ValueError(f"use tabwright.operators.impute_model for {method!r} imputation")
    raise ValueError(f"unknown imputation method {method!r}")


def impute(df: DataFrame, method: str = "mean", exclude: list[str] = ()) -> DataFrame:
    return fit_imputer(df, method, exclude).transform(df)


@dataclass
class FittedScaler:
    method: str
    center: dict[str, float]
    scale: dict[str, float]

    def expr(self, c: str) -> Column:
        return ((F.col(c).cast("double") - F.lit(self.center[c])) / F.lit(self.scale[c])).alias(c)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expr(c) if c in self.center else F.col(c) for c in df.columns])


def _nz(v):
    """Zero or undefined spread -> 1 (constant columns map to 0 / x - center)."""
    return 1.0 if v is None or v == 0 else float(v)


def fit_scaler(df: DataFrame, method: str = "zscore", exclude: list[str] = ()) -> FittedScaler:
    num = columns_of(df, "numeric", list(exclude))
    if method not in SCALE_METHODS:
        raise ValueError(f"unknown scaling method {method!r}")
    if not num:
        return FittedScaler(method, {}, {})
    x = {c: F.col(c).cast("double") for c in num}
    if method == "zscore":
        r = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(num)],
                   *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(num)]).first()
        return FittedScaler(method, {c: r[f"m{i}"] or 0.0 for i, c in enumerate(num)},
                            {c: _nz(r[f"s{i}"]) for i, c in enumerate(num)})
    if method == "minmax":
        r = df.agg(*[F.min(x[c]).alias(f"a{i}") for i, c in enumerate(num)],
                   *[F.max(x[c]).alias(f"b{i}") for i, c in enumerate(num)]).first()
        return FittedScaler(method, {c: r[f"a{i}"] or 0.0 for i, c in enumerate(num)},
                            {c: _nz(None if r[f"a{i}"] is None else r[f"b{i}"] - r[f"a{i}"]) for i, c in enumerate(num)})
    if method == "maxabs":
        r = df.agg(*[F.max(F.abs(x[c])).alias(f"a{i}") for i, c in enumerate(num)]).first()
        return FittedScaler(method, {c: 0.0 for c in num}, {c: _nz(r[f"a{i}"]) for i, c in enumerate(num)})
    q = quantile_dict(df, num, [0.25, 0.5, 0.75])
    return FittedScaler(method, {c: q.get((c, 0.5)) or 0.0 for c in num},
                        {c: _nz(None if q.get((c, 0.75)) is None else q[(c, 0.75)] - q[(c, 0.25)]) for c in num})


def scale(df: DataFrame, method: str = "zscore", exclude: list[str] = ()) -> DataFrame:
    return fit_scaler(df, method, exclude).transform(df)
