"""Registered profiling / validation queries (A1-A17)."""

from __future__ import annotations

from tabwright.operators import profile as P
from tabwright.plans.registry import register, rounded
from tabwright.plans.sqlgen import profile_sql, rnd
from tabwright.sources.tables import lineitem_with_nulls, sql_lineitem_with_nulls, table

LI_COLS = [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"),
           ("l_suppkey", "bigint", "numeric"), ("l_linenumber", "int", "numeric"),
           ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
           ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"),
           ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical"),
           ("l_shipdate", "timestamp_ntz", "other")]
CU_COLS = [("c_custkey", "bigint", "numeric"), ("c_name", "string", "categorical"),
           ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"),
           ("c_mktsegment", "string", "categorical")]
DOC_COLS = [("doc_id", "bigint", "numeric"), ("text", "string", "categorical"), ("lang", "string", "categorical"),
            ("source", "string", "categorical"), ("n_chars", "bigint", "numeric")]


@register("profile_lineitem", profile_sql(sql_lineitem_with_nulls(), LI_COLS))
def q_profile_lineitem(spark, sf):
    return rounded(P.profile(lineitem_with_nulls(spark, sf)))


@register("profile_customer", profile_sql("SELECT * FROM customer", CU_COLS))
def q_profile_customer(spark, sf):
    return rounded(P.profile(table(spark, sf, "customer")))


@register("profile_documents", profile_sql("SELECT * FROM documents", DOC_COLS))
def q_profile_documents(spark, sf):
    return rounded(P.profile(table(spark, sf, "documents")))


def _validate_sql(src: str, cols: list[tuple[str, str, str]]) -> str:
    names = [c for c, _, _ in cols]
    cats = [c for c, _, k in cols if k == "categorical"]
    nums = [c for c, _, k in cols if k == "numeric"]
    dts = [c for c, dt, _ in cols if dt.startswith("timestamp") or dt == "date"]
    nulls = " + ".join(f"({c} IS NULL)::INT" for c in names)
    width = " + ".join(
        f"coalesce(strlen({c}), 0)" if dt == "string" else
        ("4" if dt in ("int", "float", "date") else "8") for c, dt, _ in cols)
    hc = " + ".join(f"(count(DISTINCT {c}) > 50)::INT" for c in cats) or "0"
    n = len(names)
    return f"""
WITH src AS ({src}),
agg AS (
  SELECT count(*) AS n_rows, sum(({nulls})) AS missing_cells, sum(({width})) AS est_bytes, {hc} AS hc
  FROM src),
dup AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM src))
SELECT n_rows, {n} AS n_cols, n_rows * {n} AS total_cells, missing_cells::BIGINT AS missing_cells,
  {rnd(f'CASE WHEN n_rows > 0 THEN missing_cells * 100.0 / (n_rows * {n}) END')} AS missing_pct,
  n_rows - d AS duplicate_rows, {len(nums)} AS n_numeric, {len(cats)} AS n_categorical, {len(dts)} AS n_datetime,
  hc AS n_high_cardinality, est_bytes::BIGINT AS est_bytes,
  coalesce(missing_cells * 100.0 / (n_rows * {n}) > 50, false) AS issue_missing,
  (n_rows - d) > n_rows * 0.1 AS issue_duplicates, hc > 0 AS issue_cardinality
FROM agg, dup"""


@register("validate_lineitem", _validate_sql(sql_lineitem_with_nulls(), LI_COLS))
def q_validate_lineitem(spark, sf):
    return rounded(P.validate(lineitem_with_nulls(spark, sf)))


@register("validate_documents", _validate_sql("SELECT lang, source, text FROM documents",
                                              [("lang", "string", "categorical"), ("source", "string", "categorical"),
                                               ("text", "string", "categorical")]))
def q_validate_documents(spark, sf):
    return rounded(P.validate(table(spark, sf, "documents").select("lang", "source", "text")))


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", count({c}) AS count, {rnd(f'avg({x})')} AS mean, "
                     f"{rnd(f'stddev_samp({x})')} AS std, {rnd(f'min({x})')} AS min, "
                     f"{rnd(f'quantile_cont({x}, 0.25)')} AS p25, {rnd(f'quantile_cont({x}, 0.5)')} AS p50, "
                     f"{rnd(f'quantile_cont({x}, 0.75)')} AS p75, {rnd(f'max({x})')} AS max FROM src")
    return f"WITH src AS ({src}) " + " UNION ALL ".join(parts)


ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@register("describe_orders", _describe_sql("SELECT * FROM orders", ORD_NUM))
def q_describe_orders(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "orders")))


@register("missing_lineitem", f"""
WITH src AS ({sql_lineitem_with_nulls()})
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM src" for c, _, _ in LI_COLS)
    + ") WHERE missing > 0")
def q_missing_lineitem(spark, sf):
    return P.missing_by_column(lineitem_with_nulls(spark, sf))


_VC_COLS = ["o_orderstatus", "o_orderpriority"]


@register("value_counts_orders", """
WITH long AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
f AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
u AS (SELECT "column" FROM f GROUP BY "column" HAVING count(*) <= 10),
r AS (SELECT f.*, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank
      FROM f WHERE "column" IN (SELECT "column" FROM u))
SELECT "column", value, n, rank FROM r WHERE rank <= 5""")
def q_value_counts_orders(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), columns=_VC_COLS)


@register("high_cardinality_part", """
SELECT * FROM (
  SELECT 'p_name' AS "column", count(DISTINCT p_name) AS unique_values FROM part
  UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part) WHERE unique_values > 50""")
def q_high_cardinality_part(spark, sf):
    return P.high_cardinality(table(spark, sf, "part"))


@register("target_numeric_lineitem", f"""
WITH a AS (SELECT count(*) AS rows, count(l_extendedprice) AS non_null, count(DISTINCT l_extendedprice) AS n_unique,
  min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, avg(l_extendedprice) AS mean,
  stddev_samp(l_extendedprice) AS std, skewness(l_extendedprice) AS sk FROM lineitem)
SELECT 'l_extendedprice' AS target, 'numeric' AS kind, s.stat, {rnd('s.value')} AS value, NULL::BIGINT AS n
FROM a, (VALUES (1)) v(x), LATERAL (SELECT unnest(['rows','non_null','n_unique','min','max','mean','std','skewness']) AS stat,
  unnest([rows::DOUBLE, non_null::DOUBLE, n_unique::DOUBLE, mn, mx, mean, std, sk]) AS value) s""")
def q_target_numeric(spark, sf):
    return rounded(P.analyze_target(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("target_categorical_orders", """
SELECT 'o_orderpriority' AS target, 'categorical' AS kind, o_orderpriority AS stat, NULL::DOUBLE AS value,
  count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
ORDER BY n DESC, stat LIMIT 10""")
def q_target_categorical(spark, sf):
    return rounded(P.analyze_target(table(spark, sf, "orders"), "o_orderpriority"))


@register("value_counts_conversations", """
WITH f AS (SELECT 'role' AS "column", role AS value, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY ALL)
SELECT "column", value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank FROM f
QUALIFY rank <= 5""")
def q_value_counts_conversations(spark, sf):
    return P.value_counts(table(spark, sf, "conversations").select("role"))


# fixed values: names of the same types in DuckDB
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


@register("dtype_counts_lineitem", "SELECT CASE column_type " + " ".join(
    f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())
    + " END AS dtype, CAST(count(*) AS INTEGER) AS n_columns FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY 1")
def q_dtype_counts(spark, sf):
    return P.dtype_counts(table(spark, sf, "lineitem"))


_SUMMARY_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


# the summary's values are text; numbers in it are compared as numbers
@register("data_summary_values_orders", f"""
WITH d AS ({_describe_sql("SELECT * FROM orders", _SUMMARY_NUM)}),
f AS (SELECT 'o_orderstatus' AS key, o_orderstatus AS item, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL)
SELECT 'shape' AS section, 'rows' AS key, '' AS item, count(*)::DOUBLE AS value FROM orders
UNION ALL SELECT 'shape', 'columns', '', (SELECT count(*) FROM (DESCRIBE SELECT * FROM orders))::DOUBLE
UNION ALL SELECT 'describe', "column", unnest(['count','mean','std','min','p25','p50','p75','max']),
  unnest([round(count::DOUBLE, 4), round(mean, 4), round(std, 4), round(min, 4), round(p25, 4), round(p50, 4), round(p75, 4),
          round(max, 4)]) FROM d
UNION ALL SELECT 'value_counts', key, item, n::DOUBLE FROM f
  WHERE item IS NOT NULL AND key IN (SELECT key FROM f GROUP BY key HAVING count(*) <= 10)
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, item) <= 5""")
def q_data_summary_values(spark, sf):
    from pyspark.sql import functions as F
    s = P.data_summary(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                         "o_orderdate", "o_orderpriority"))
    return s.where("section <> 'types'").withColumn("value", F.round(F.col("value").cast("double"), 4))


# fixed values: untidy names and what they become
_UNTIDY = {"c_custkey": " Cust Key ", "c_name": "cust key!", "c_nationkey": "Nation (Key)", "c_acctbal": "2nd balance %"}


@register("clean_names_customer", "SELECT c_custkey AS cust_key, c_name AS cust_key_1, c_nationkey AS nation_key, "
          "c_acctbal AS col_2nd_balance FROM customer")
def q_clean_names(spark, sf):
    from tabwright.functions.names import clean_column_names
    c = table(spark, sf, "customer").select(*_UNTIDY)
    return clean_column_names(c.toDF(*_UNTIDY.values()))
