"""Model-based imputation: k nearest neighbours and iterative (chained) regression.

kNN: every gap becomes the mean of the k nearest donors' values, by the distance on the columns that row and donor
share (``masked_knn``); donors may have gaps of their own.

Iterative: start from column means, then for a fixed number of rounds refit,
for every column with gaps, a Bayesian ridge regression on the other columns
(one Gram aggregate over rows where the column is observed) and replace the
originally missing entries with its predictions. Lineage is cut every round.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.linalg import gram, linear
from tabwright.models.linear import _centered, bayes_ridge
from tabwright.operators.masked_knn import gap_means, vector
from tabwright.session import cut_lineage


def knn_impute(df: DataFrame, features: list[str], id_col: str | None = None, k: int = 5,
               donors: DataFrame | None = None) -> DataFrame:
    """Fill the gaps of ``df`` (null or NaN) from rows of ``donors`` (default: of ``df`` itself).

    A gap becomes the mean of the ``k`` nearest donors that have its column and share a known one with the row (fewer
    donors: of all of them; none: the column's mean over the donors; a column without any value stays null). Ties at the
    k-th distance are won by the smaller values, repeated donors count as often as they come. All rows and other
    columns are kept; rows need no id (``id_col`` is accepted and not read).
    """
    source = (df if donors is None else donors).select(vector(features).alias("vec"))
    at = [F.get("vec", F.lit(i)) for i in range(len(features))]
    stats = source.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(at)],
                       *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(at)]).first()
    holed = df.withColumn("__vec", vector(features))
    hole = F.exists("__vec", lambda v: v.isNull())
    fills = gap_means(holed.where(hole).select(F.col("__vec").alias("vec")), source, k,
                      [stats[f"s{i}"] for i in range(len(features))])
    gaps = holed.where(hole)
    if fills is None:
        gaps = gaps.withColumn("__fills", F.lit(None).cast("map<int,double>"))
    else:
        gaps = gaps.join(fills.select(F.col("vec").alias("__vec"), F.col("fills").alias("__fills")), "__vec", "left")
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)),
                            F.try_element_at("__fills", F.lit(i)).cast(df.schema[c].dataType),
                            F.lit(stats[f"m{i}"]).cast(df.schema[c].dataType)) for i, c in enumerate(features)}
    return df.where(~F.exists(vector(features), lambda v: v.isNull())).unionByName(
        gaps.withColumns(filled).select(*df.columns))


def fit_iterative(df: DataFrame, features: list[str], rounds: int = 10, tol: float = 1e-3) -> FittedIterative:
    """Chained Bayesian ridge regressions, learnt on ``df``; ends early once a round changes no filled value by more
    than ``tol`` times its column's standard deviation (``converged`` tells which)."""
    agg = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)],
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(features)]).first()
    fitted = FittedIterative(list(features), {c: agg[f"m{i}"] for i, c in enumerate(features)})
    gaps = [c for i, c in enumerate(features) if agg[f"g{i}"] and agg[f"m{i}"] is not None]
    spread = {c: agg[f"s{i}"] or 0.0 for i, c in enumerate(features)}
    if not gaps:
        fitted.converged = True
        return fitted
    usable = [c for c in features if fitted.means[c] is not None]
    cur = cut_lineage(fitted.start(df))
    for _ in range(rounds):
        before = cur
        for c in gaps:
            others = [o for o in usable if o != c]
            if not others:
                continue
            g = gram(cur, others, c, where=~F.col(f"__m_{c}"))
            n, mx, my, G, cv, yy = _centered(g)
            b = bayes_ridge(G, cv, yy, n)
            step = (c, others, [float(x) for x in b], float(my - mx @ b))
            fitted.steps.append(step)
            cur = fitted.apply(cur, step)
        cur = cut_lineage(cur.withColumns({f"__d_{c}": F.abs(F.col(c) - F.col(f"__p_{c}")) for c in gaps}
                                          if f"__p_{gaps[0]}" in before.columns else
                                          {f"__d_{c}": F.lit(None).cast("double") for c in gaps})
                          .withColumns({f"__p_{c}": F.col(c) for c in gaps}))
        moved = cur.agg(*[F.max(F.when(F.col(f"__m_{c}"), F.col(f"__d_{c}"))).alias(c) for c in gaps]).first()
        if all(moved[c] is not None and moved[c] <= tol * spread[c] for c in gaps):
            fitted.converged = True
            break
    return fitted


@dataclass
class FittedIterative:
    """The regressions of ``fit_iterative`` in order; ``transform`` replays them on any rows."""

    features: list[str]
    means: dict[str, float | None]
    steps: list[tuple] = field(default_factory=list)
    converged: bool = False

    def start(self, df: DataFrame) -> DataFrame:
        """Gaps flagged and filled with the means."""
        df = df.withColumns({f"__m_{c}": F.col(c).isNull() for c in self.features})
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(self.means[c]).cast("double"))
                               for c in self.features})

    @staticmethod
    def apply(df: DataFrame, step: tuple) -> DataFrame:
        c, others, b, intercept = step
        return df.withColumn(c, F.when(F.col(f"__m_{c}"), linear(others, b, intercept)).otherwise(F.col(c)))

    def transform(self, df: DataFrame) -> DataFrame:
        cur = self.start(df)
        for i, step in enumerate(self.steps):
            cur = self.apply(cur, step)
            if i % 20 == 19 and not df.isStreaming:
                cur = cut_lineage(cur)  # keeps the plan short
        return cur.drop(*[f"__m_{c}" for c in self.features])

    @property
    def fills(self) -> dict:
        return self.means


@dataclass
class FittedKnn:
    """Donors for ``knn_impute``: the training rows."""

    features: list[str]
    donors: DataFrame
    key: list[str]
    k: int = 5

    def transform(self, df: DataFrame) -> DataFrame:
        return knn_impute(df, self.features, k=self.k, donors=self.donors)

    @property
    def fills(self) -> dict:
        return dict.fromkeys(self.features)


@dataclass
class FittedChain:
    """Imputers applied one after the other."""

    parts: list

    def transform(self, df: DataFrame) -> DataFrame:
        for p in self.parts:
            df = p.transform(df)
        return df

    @property
    def fills(self) -> dict:
        return {c: v for p in self.parts for c, v in p.fills.items()}


def fit_model_imputer(df: DataFrame, method: str, numeric: list[str], strings: list[str], key: list[str], k: int = 5,
                      rounds: int = 10):
    """``knn`` or ``iterative`` for the numeric columns, the mode for string columns, learnt on ``df``."""
    from tabwright.operators.prep import fit_imputer
    parts = [fit_imputer(df.select(*strings), "mode")] if strings else []
    if numeric and method == "knn":
        parts.append(FittedKnn(numeric, cut_lineage(df.select(*key, *[F.col(c).cast("double").alias(c) for c in numeric])),
                               key, k))
    elif numeric and method == "iterative":
        parts.append(fit_iterative(df, numeric, rounds))
    elif numeric:
        raise ValueError(f"unknown imputation method {method!r}")
    return FittedChain(parts)


def iterative_impute(df: DataFrame, features: list[str], rounds: int = 10) -> DataFrame:
    """``df`` with the gaps of ``features`` filled by ``fit_iterative`` on the table itself."""
    return fit_iterative(df, features, rounds).transform(df)
