"""Imports every query module so the registry is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.plans import q_metrics, q_models, q_neighbors, q_prep, q_profile  # noqa: F401
from tabwright.plans.registry import ORACLES, QUERIES


def all_queries():
    return QUERIES


def all_oracles():
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["prep_slice_lineitem"](spark, sf_dir)
