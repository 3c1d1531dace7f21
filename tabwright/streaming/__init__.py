"""Streaming use of fitted operators.

The reference has no stream processing. What carries over to Structured
Streaming is every *fitted* transform: imputation, scaling, type casts,
encodings and model scoring are stateless projections with literal constants
(or broadcast model parameters), so they apply to a streaming DataFrame
unchanged. Fitting itself is a batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, experiment, fitted) -> DataFrame:
    """Prepare a streaming DataFrame with the experiment's fitted preparation and score it.

    Works for models whose transform is a projection (linear family, discriminants,
    Spark ML pipelines, boosting, MLP); kNN scoring joins with the training rows and
    is a stream-static join.
    """
    return fitted.transform(experiment.transform(stream))
