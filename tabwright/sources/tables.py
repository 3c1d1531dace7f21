"""Parquet scans of the test tables, plus the missing-value variants used for imputation tests.

Test tables hold no nulls, so missing values are injected by a rule on the
key that any SQL engine can repeat; no rows are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import normalize_nan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Null-injection rules shared with the SQL oracles.
LINEITEM_NULL_RULES = {
    "l_quantity": ("l_orderkey", 7),
    "l_returnflag": ("l_orderkey", 11),
    "l_discount": ("l_partkey", 13),
}


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cols = []
    for c in li.columns:
        if c in LINEITEM_NULL_RULES:
            k, m = LINEITEM_NULL_RULES[c]
            cols.append(F.when(F.col(k) % m == 0, F.lit(None).cast(li.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return normalize_nan(li.select(*cols))


def sql_lineitem_with_nulls() -> str:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    out = []
    for c in cols:
        if c in LINEITEM_NULL_RULES:
            k, m = LINEITEM_NULL_RULES[c]
            out.append(f"CASE WHEN {k} % {m} = 0 THEN NULL ELSE {c} END AS {c}")
        else:
            out.append(c)
    return "SELECT " + ", ".join(out) + " FROM lineitem"


# (l_orderkey, l_linenumber, l_partkey, l_suppkey) + l_extendedprice is unique in lineitem.
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINEITEM_TIEBREAK = ["l_suppkey", "l_extendedprice"]
