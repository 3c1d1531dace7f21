"""Common model interface.

``Model.fit(df, features, label)`` returns a ``Fitted`` whose ``transform(df)``
adds ``prediction`` (and ``score``: positive-class probability for binary
classifiers, when the model has one). Features are double columns; labels
for classifiers are class indices 0..K-1 (``Experiment`` does the indexing).

Spark ML estimators are wrapped with a ``VectorAssembler``; custom models hold
driver-side constants (coefficients, trees, centres) that are small by
construction and are applied as column expressions or broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.models import store


class Fitted:
    """A fitted model: ``model_id`` and ``features`` are set by subclasses."""

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def importances(self) -> list[tuple[str, float]] | None:
        return None

    def save(self, path: str) -> None:
        """Write the model below ``path`` through Spark's file system."""
        store.save(SparkSession.active(), self, path)


def load_fitted(path: str) -> Fitted:
    return store.load(SparkSession.active(), path)


@dataclass
class SparkFitted(Fitted):
    model_id: str
    features: list[str]
    pipeline: PipelineModel
    classification: bool
    n_classes: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.pipeline.transform(df)
        cols = [c for c in df.columns if c != "prediction"] + [F.col("prediction").cast("double").alias("prediction")]
        src = "probability" if "probability" in out.columns else (
            "rawPrediction" if "rawPrediction" in out.columns else None)
        if self.classification and src:
            pa = vector_to_array(src)  # raw margins stand in for probabilities where a model has none
            cols.append(F.when(F.size(pa) >= 2, pa[1]).alias("score"))
            cols.append(pa.alias("probability"))
        return out.select(*cols)

    def importances(self):
        m = self.pipeline.stages[-1]
        inner = getattr(m, "models", None)
        if hasattr(m, "featureImportances"):
            v = m.featureImportances.toArray()
        elif hasattr(m, "coefficients"):
            v = np.abs(m.coefficients.toArray())
        elif hasattr(m, "coefficientMatrix"):
            v = np.abs(m.coefficientMatrix.toArray()[0])
        elif inner:
            first = inner[0]
            if hasattr(first, "featureImportances"):
                v = np.mean([x.featureImportances.toArray() for x in inner], axis=0)
            elif hasattr(first, "coefficients"):
                v = np.abs(first.coefficients.toArray())
            else:
                return None
        else:
            return None
        return sorted(zip(self.features, map(float, v)), key=lambda t: (-t[1], t[0]))


@dataclass
class Model:
    model_id: str
    problem: str
    title: str
    approximate: bool = False
    params: dict = field(default_factory=dict)

    def with_params(self, **p) -> Model:
        q = dict(self.params)
        q.update(p)
        return type(self)(self.model_id, self.problem, self.title, self.approximate, q)

    def fit(self, df: DataFrame, features: list[str], label: str | None = None) -> Fitted:  # pragma: no cover
        raise NotImplementedError


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


@dataclass
class SparkModel(Model):
    """Wraps a Spark ML estimator factory ``make(params) -> Estimator``."""
    make: object = None

    def with_params(self, **p) -> Model:
        q = dict(self.params)
        q.update(p)
        return SparkModel(self.model_id, self.problem, self.title, self.approximate, q, self.make)

    def fit(self, df, features, label=None):
        n = 0
        if self.problem == "classification" and label is not None:
            n = int(df.agg(F.max(label)).first()[0] or 0) + 1
        est = self.make(self.params, n, len(features))
        if label is not None and hasattr(est, "setLabelCol"):
            est = est.setLabelCol(label)
        pm = Pipeline(stages=[assembler(features), est]).fit(df)
        return SparkFitted(self.model_id, features, pm, self.problem == "classification", n)
