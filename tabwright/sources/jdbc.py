"""JDBC sources (SQL Server, Databricks SQL, any JDBC URL) and the synthetic regression table.

Rows arrive in executors: with ``partition_column`` and bounds the read is
split into ``num_partitions`` range queries; otherwise a single query. Filters
and projections applied to the returned DataFrame are pushed into the remote
SQL where the dialect allows. Credentials are connection properties only and
are never part of saved configuration.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.columns import normalize_nan


def sqlserver_url(server: str, database: str, encrypt: bool = True) -> str:
    return (f"jdbc:sqlserver://{server};databaseName={database};encrypt={'true' if encrypt else 'false'};"
            "trustServerCertificate=false")


def databricks_url(server_hostname: str, http_path: str) -> str:
    return f"jdbc:databricks://{server_hostname}:443/default;transportMode=http;ssl=1;httpPath={http_path};AuthMech=3"


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              user: str | None = None, password: str | None = None, driver: str | None = None,
              partition_column: str | None = None, lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None, fetch_size: int = 10000) -> DataFrame:
    if (query is None) == (table is None):
        raise ValueError("give exactly one of query or table")
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    if driver:
        r = r.option("driver", driver)
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    if partition_column:
        if table is None:
            # partitioned reads need a table expression: wrap the query as a derived table
            table = f"({query}) q"
        r = (r.option("dbtable", table).option("partitionColumn", partition_column)
             .option("lowerBound", lower_bound).option("upperBound", upper_bound)
             .option("numPartitions", num_partitions or 8))
    elif query is not None:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    return normalize_nan(r.load())


def load_from_sql(spark, server, database, username, password, query, **kw) -> DataFrame:
    return read_jdbc(spark, sqlserver_url(server, database), query=query, user=username, password=password,
                     driver="com.microsoft.sqlserver.jdbc.SQLServerDriver", **kw)


def load_from_databricks(spark, server_hostname, http_path, access_token, query, **kw) -> DataFrame:
    return read_jdbc(spark, databricks_url(server_hostname, http_path), query=query, user="token",
                     password=access_token, driver="com.databricks.client.jdbc.Driver", **kw)


# Column names of the synthetic housing-style regression table.
HOUSING_COLUMNS = ["crim", "zn", "indus", "chas", "nox", "rm", "age", "dis", "rad", "tax", "ptratio", "b", "lstat"]


def make_regression(spark: SparkSession, n: int = 506, d: int = 13, informative: int = 10, noise: float = 0.1,
                    seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Gaussian features from ``randn(seed + i)`` over ``spark.range(n)``; the target is a linear combination
    of the first ``informative`` features (coefficients drawn on the driver, d of them) plus Gaussian noise."""
    names = HOUSING_COLUMNS if d == len(HOUSING_COLUMNS) else [f"x{i}" for i in range(d)]
    rng = np.random.default_rng(seed)
    coef = np.zeros(d)
    coef[:informative] = rng.uniform(0, 100, size=informative)
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    df = base.select("id", *[F.randn(seed + i).alias(names[i]) for i in range(d)])
    y = F.lit(0.0)
    for i in range(d):
        if coef[i] != 0:
            y = y + F.lit(float(coef[i])) * F.col(names[i])
    return df.withColumn("target", y + F.lit(noise) * F.randn(seed + d + 1))
