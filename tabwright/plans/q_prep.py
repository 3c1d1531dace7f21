"""Registered type-advice, preprocessing, sampling and selection queries (T, I, N, M, B1, F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.columns import sql_md5_order, sql_md5_unit
from tabwright.operators import prep, sample, select, types
from tabwright.plans.q_profile import LI_COLS
from tabwright.plans.registry import register, rounded
from tabwright.plans.sqlgen import rnd
from tabwright.sources.tables import LINEITEM_KEY, lineitem_with_nulls, sql_lineitem_with_nulls, table

# ---------------------------------------------------------------- type advice

_STR_SRC_SQL = ("SELECT l_orderkey, CAST(l_quantity AS VARCHAR) AS qty_text, CAST(l_extendedprice AS VARCHAR) AS "
                "price_text, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ship_text, l_returnflag, l_linestatus, "
                "l_discount FROM lineitem")


def _str_src(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_quantity").cast("string").alias("qty_text"),
                     F.col("l_extendedprice").cast("string").alias("price_text"),
                     F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship_text"),
                     "l_returnflag", "l_linestatus", "l_discount")


def _advice_sql(src: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for c, dt in cols:
        if dt == "string":
            d = f"TRY_CAST({c} AS DOUBLE)"
            adv = (f"CASE WHEN bool_and({c} IS NULL OR {d} IS NOT NULL) THEN "
                   f"CASE WHEN bool_and({c} IS NULL OR {d} = floor({d})) THEN 'int64' ELSE 'float64' END "
                   f"WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) THEN 'datetime64[ns]' "
                   f"WHEN count(DISTINCT {c}) / count(*) < 0.1 THEN 'category' ELSE 'object' END")
            st = (f"CASE WHEN bool_and({c} IS NULL OR {d} IS NOT NULL) THEN "
                  f"CASE WHEN bool_and({c} IS NULL OR {d} = floor({d})) THEN 'bigint' ELSE 'double' END "
                  f"WHEN bool_and({c} IS NULL OR TRY_CAST({c} AS TIMESTAMP) IS NOT NULL) THEN 'timestamp_ntz' "
                  f"ELSE 'string' END")
            ll = "NULL::BOOLEAN"
        elif dt == "bigint":
            adv = (f"CASE WHEN min({c}) >= 0 THEN CASE WHEN max({c}) <= 255 THEN 'uint8' WHEN max({c}) <= 65535 THEN "
                   f"'uint16' WHEN max({c}) <= 4294967295 THEN 'uint32' ELSE 'uint64' END "
                   f"WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'int8' WHEN min({c}) >= -32768 AND max({c}) <= 32767 "
                   f"THEN 'int16' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int32' ELSE 'int64' END")
            st = (f"CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND "
                  f"max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 "
                  f"THEN 'int' ELSE 'bigint' END")
            ll = "NULL::BOOLEAN"
        else:  # double
            adv = (f"CASE WHEN min({c}) >= -3.4028234663852886e38 AND max({c}) <= 3.4028234663852886e38 "
                   f"THEN 'float32' ELSE 'float64' END")
            st = (f"CASE WHEN min({c}) >= -3.4028234663852886e38 AND max({c}) <= 3.4028234663852886e38 "
                  f"THEN 'float' ELSE 'double' END")
            ll = f"coalesce(bool_and({c} IS NULL OR CAST(CAST({c} AS FLOAT) AS DOUBLE) = {c}), true)"
        parts.append(f"SELECT '{c}' AS \"column\", '{dt}' AS dtype, {adv} AS advice, {st} AS spark_type, "
                     f"{ll} AS lossless FROM src")
    return f"WITH src AS ({src}) " + " UNION ALL ".join(parts)


_ADV_COLS = [("l_orderkey", "bigint"), ("qty_text", "string"), ("price_text", "string"), ("ship_text", "string"),
             ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_discount", "double")]


@register("type_advice_lineitem", _advice_sql(_STR_SRC_SQL, _ADV_COLS))
def q_type_advice(spark, sf):
    return types.suggest_types(_str_src(spark, sf))


@register("type_advice_events", _advice_sql("SELECT event_id, user_id, event_type, value, props FROM events",
                                            [("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"),
                                             ("value", "double"), ("props", "string")]))
def q_type_advice_events(spark, sf):
    return types.suggest_types(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"))


# the advised integer type follows the data: at sf0.01 every l_orderkey fits a smallint
@register("apply_types_lineitem", f"""
WITH src AS ({_STR_SRC_SQL})
SELECT CAST(l_orderkey AS SMALLINT) AS l_orderkey, CAST(TRY_CAST(qty_text AS DOUBLE) AS BIGINT) AS qty_text,
  {rnd('TRY_CAST(price_text AS DOUBLE)')} AS price_text, TRY_CAST(ship_text AS TIMESTAMP) AS ship_text,
  l_returnflag, l_linestatus, {rnd('CAST(l_discount AS FLOAT)')} AS l_discount FROM src""")
def q_apply_types(spark, sf):
    src = _str_src(spark, sf)
    return rounded(types.apply_types(src, types.suggest_types(src)))


# ---------------------------------------------------------------- imputation

def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM src WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _impute_sql(method: str) -> str:
    out = []
    for c, dt, k in LI_COLS:
        if k == "numeric":
            if method == "mode":
                e = f"coalesce({c}, {_mode_sql(c)})"
                out.append(f"{rnd(e)} AS {c}" if dt == "double" else f"{e} AS {c}")
            else:
                fn = "avg" if method == "mean" else "quantile_cont"
                arg = "" if method == "mean" else ", 0.5"
                out.append(f"{rnd(f'coalesce(CAST({c} AS DOUBLE), (SELECT {fn}(CAST({c} AS DOUBLE){arg}) FROM src))')} AS {c}")
        elif k == "categorical":
            out.append(f"coalesce({c}, {_mode_sql(c)}, 'Unknown') AS {c}")
        else:
            out.append(f"coalesce({c}, {_mode_sql(c)}) AS {c}" if method == "mode" else c)
    return f"WITH src AS ({sql_lineitem_with_nulls()}) SELECT " + ", ".join(out) + " FROM src"


@register("impute_mean_lineitem", _impute_sql("mean"))
def q_impute_mean(spark, sf):
    return rounded(prep.impute(lineitem_with_nulls(spark, sf), "mean"))


@register("impute_median_lineitem", _impute_sql("median"))
def q_impute_median(spark, sf):
    return rounded(prep.impute(lineitem_with_nulls(spark, sf), "median"))


@register("impute_mode_lineitem", _impute_sql("mode"))
def q_impute_mode(spark, sf):
    return rounded(prep.impute(lineitem_with_nulls(spark, sf), "mode"))


# ---------------------------------------------------------------- scaling

_SCALE_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SCALE_KEEP = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _scale_sql(method: str) -> str:
    out = []
    for c in _SCALE_X:
        x = f"CAST({c} AS DOUBLE)"
        if method == "zscore":
            e = f"({x} - (SELECT avg({x}) FROM src)) / coalesce(nullif((SELECT stddev_pop({x}) FROM src), 0), 1)"
        elif method == "minmax":
            e = (f"({x} - (SELECT min({x}) FROM src)) / coalesce(nullif((SELECT max({x}) - min({x}) FROM src), 0), 1)")
        elif method == "maxabs":
            e = f"{x} / coalesce(nullif((SELECT max(abs({x})) FROM src), 0), 1)"
        else:
            e = (f"({x} - (SELECT quantile_cont({x}, 0.5) FROM src)) / coalesce(nullif((SELECT "
                 f"quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) FROM src), 0), 1)")
        out.append(f"{rnd(e)} AS {c}")
    return (f"WITH src AS ({sql_lineitem_with_nulls()}) SELECT {', '.join(_SCALE_KEEP)}, " + ", ".join(out)
            + " FROM src")


def _scale_q(method):
    def q(spark, sf):
        df = lineitem_with_nulls(spark, sf).select(*_SCALE_KEEP, *_SCALE_X)
        return rounded(prep.scale(df, method, exclude=_SCALE_KEEP))
    return q


for _m in prep.SCALE_METHODS:
    register(f"scale_{_m}_lineitem", _scale_sql(_m))(_scale_q(_m))


# ---------------------------------------------------------------- sampling, split, folds

_LI_MD5 = sql_md5_order(LINEITEM_KEY, 42)


@register("sample_random_lineitem", f"""
WITH r AS (SELECT {', '.join(LINEITEM_KEY)}, l_extendedprice,
  row_number() OVER (ORDER BY {_LI_MD5}, l_extendedprice) AS rn FROM lineitem)
SELECT {', '.join(LINEITEM_KEY)}, {rnd('l_extendedprice')} AS l_extendedprice FROM r
WHERE rn <= (SELECT floor(count(*) * 10 / 100.0) FROM lineitem)""")
def q_sample_random(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINEITEM_KEY, "l_extendedprice")
    return rounded(sample.random_sample(li, 10, LINEITEM_KEY, ["l_extendedprice"], seed=42))


@register("sample_stratified_lineitem", f"""
WITH c AS (SELECT l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS tot, CAST(floor(sum(n) * 10 / 100.0) AS BIGINT) AS k FROM c),
b AS (SELECT y, n, (n * k) // tot AS base, (n * k) % tot AS rem FROM c, t),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= (SELECT k FROM t) - (SELECT sum(base) FROM b)
      THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT {', '.join(LINEITEM_KEY)}, l_extendedprice, l_returnflag,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LI_MD5}, l_extendedprice) AS rn FROM lineitem)
SELECT {', '.join(LINEITEM_KEY)}, {rnd('l_extendedprice')} AS l_extendedprice, l_returnflag
FROM r JOIN q ON r.l_returnflag = q.y WHERE rn <= quota""")
def q_sample_stratified(spark, sf):
    li = table(spark, sf, "lineitem").select(*LINEITEM_KEY, "l_extendedprice", "l_returnflag")
    return rounded(sample.stratified_sample(li, "l_returnflag", 10, LINEITEM_KEY, ["l_extendedprice"], seed=42))


@register("split_orders", f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {sql_md5_order(['o_orderkey'], 123)})
  <= (SELECT floor(count(*) * 0.8) FROM orders) AS is_train FROM orders""")
def q_split_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return sample.train_test_split(o, ["o_orderkey"], 0.8, seed=123)


@register("split_stratified_orders", f"""
WITH c AS (SELECT o_orderstatus AS y, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS tot, CAST(floor(sum(n) * 0.8) AS BIGINT) AS k FROM c),
b AS (SELECT y, n, (n * k) // tot AS base, (n * k) % tot AS rem FROM c, t),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= (SELECT k FROM t) - (SELECT sum(base) FROM b)
      THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_md5_order(['o_orderkey'], 123)}) AS rn FROM orders)
SELECT o_orderkey, o_orderstatus, rn <= quota AS is_train FROM r JOIN q ON r.o_orderstatus = q.y""")
def q_split_stratified(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sample.train_test_split(o, ["o_orderkey"], 0.8, target="o_orderstatus", seed=123)


@register("folds_orders", f"SELECT o_orderkey, CAST({sql_md5_unit(['o_orderkey'], 123)} % 5 AS INTEGER) AS fold FROM orders")
def q_folds_orders(spark, sf):
    return sample.kfold(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, seed=123)


@register("undersample_labels", f"""
WITH m AS (SELECT min(n) AS m FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {sql_md5_order(['doc_id'], 42)}) AS rn
      FROM labels)
SELECT doc_id, toxic FROM r WHERE rn <= (SELECT m FROM m)""")
def q_undersample(spark, sf):
    return sample.undersample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"], seed=42)


# ---------------------------------------------------------------- univariate selection

_F_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _anova_sql() -> str:
    parts = []
    for c in _F_X:
        parts.append(f"""SELECT '{c}' AS feature, {rnd('(ssb / (g - 1)) / (ssw / (n - g))', 4)} AS f_score FROM (
  SELECT count(*) AS g, sum(cnt) AS n,
    sum(cnt * (mu - (SELECT avg({c}) FROM lineitem)) ^ 2) AS ssb, sum(w) AS ssw FROM (
    SELECT l_returnflag, count(*) AS cnt, avg({c}) AS mu, var_pop({c}) * count(*) AS w FROM lineitem GROUP BY 1))""")
    return "WITH s AS (" + " UNION ALL ".join(parts) + (") SELECT feature, f_score, "
            "CAST(row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS INTEGER) AS rank, "
            "row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) <= 2 AS selected FROM s")


@register("anova_f_lineitem", _anova_sql())
def q_anova(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(select.univariate_select(li, _F_X, "l_returnflag", 2, classification=True), 4)


@register("regression_f_lineitem", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd(f'corr({c}, l_extendedprice) ^ 2 / (1 - corr({c}, l_extendedprice) ^ 2) * (count(*) - 2)', 4)} AS f_score FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax"]) + """) SELECT feature, f_score,
  CAST(row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) AS INTEGER) AS rank,
  row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature) <= 1 AS selected FROM s""")
def q_regression_f(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(select.univariate_select(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1,
                                            classification=False), 4)


# ---------------------------------------------------------------- flagship slice (entry)

_SL_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _slice_sql() -> str:
    from tabwright.plans.q_profile import profile_sql
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT avg(CAST({c} AS DOUBLE)) FROM src)) AS {c}" for c in _SL_NUM)
    sc = ", ".join(f"({c} - (SELECT avg({c}) FROM imp)) / coalesce(nullif((SELECT stddev_pop({c}) FROM imp), 0), 1) AS {c}"
                   for c in _SL_NUM)
    keys = ", ".join(LINEITEM_KEY)
    md5 = sql_md5_order(LINEITEM_KEY, 42)
    body = f"""WITH src AS ({sql_lineitem_with_nulls()}),
imp AS (SELECT {keys}, {imp}, l_returnflag,
  coalesce(l_linestatus, {_mode_sql('l_linestatus')}, 'Unknown') AS l_linestatus FROM src),
scl AS (SELECT {keys}, {sc}, l_returnflag, l_linestatus FROM imp),
c AS (SELECT l_returnflag AS y, count(*) AS n FROM scl GROUP BY 1),
t AS (SELECT sum(n) AS tot, CAST(floor(sum(n) * 10 / 100.0) AS BIGINT) AS k FROM c),
b AS (SELECT y, n, (n * k) // tot AS base, (n * k) % tot AS rem FROM c, t),
q AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= (SELECT k FROM t) - (SELECT sum(base) FROM b)
      THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {md5}, l_extendedprice) AS rn FROM scl)
SELECT {keys}, {', '.join(_SL_NUM)}, l_returnflag, l_linestatus FROM r JOIN q ON r.l_returnflag IS NOT DISTINCT FROM q.y
WHERE rn <= quota"""
    cols = [("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
            ("l_linenumber", "int", "numeric")] + [(c, "double", "numeric") for c in _SL_NUM] + [
        ("l_returnflag", "string", "categorical"), ("l_linestatus", "string", "categorical")]
    return profile_sql(body, cols)


@register("prep_slice_lineitem", _slice_sql())
def q_prep_slice(spark, sf):
    """Impute mean (target excluded) -> z-score -> 10 % stratified sample by the target -> column profile."""
    from tabwright.operators.profile import profile
    li = lineitem_with_nulls(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_SL_NUM,
                                               "l_returnflag", "l_linestatus")
    imp = prep.impute(li, "mean", exclude=[*LINEITEM_KEY, "l_returnflag"])
    scl = prep.scale(imp, "zscore", exclude=LINEITEM_KEY)
    smp = sample.stratified_sample(scl, "l_returnflag", 10, LINEITEM_KEY, ["l_extendedprice"], seed=42)
    return rounded(profile(smp))


_GUESS = ["l_quantity", "l_linenumber", "l_discount", "l_returnflag", "l_shipdate"]


@register("guess_task_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS target, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) >= 20 AND "
    f"{str(c not in ('l_returnflag', 'l_shipdate')).upper()} THEN 'regression' ELSE 'classification' END AS task FROM lineitem"
    for c in _GUESS))
def q_guess_task(spark, sf):
    from tabwright.operators.sample import guess_task
    return guess_task(table(spark, sf, "lineitem"), _GUESS)


# integer keys above 2**53, which a double can't tell apart
@register("profile_big_keys_orders", """
WITH k AS (SELECT 9007199254740992 + o_orderkey AS k FROM orders)
SELECT 'k' AS "column", count(k) AS non_null, count(DISTINCT k) AS n_unique FROM k""")
def q_big_keys(spark, sf):
    from tabwright.operators.profile import profile
    df = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(9007199254740992)).alias("k"))
    return profile(df).select("column", "non_null", "n_unique")


@register("impute_mode_big_keys_lineitem", """
WITH k AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE 9007199254740992 + l_suppkey END AS k FROM lineitem),
m AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)
SELECT coalesce(k.k, m.k) AS k, count(*) AS n FROM k, m GROUP BY 1""")
def q_mode_big_keys(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.col("l_suppkey") + F.lit(9007199254740992)).alias("k"))
    return prep.impute(df, "mode").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@register("text_big_keys_orders", "SELECT 9007199254740992 + o_orderkey AS k FROM orders")
def q_text_big_keys(spark, sf):
    from tabwright.operators.types import apply_types
    df = table(spark, sf, "orders").select((F.col("o_orderkey") + F.lit(9007199254740992)).cast("string").alias("k"))
    return apply_types(df, {"k": "bigint"})


# what must hold whatever the regressions find: no gap left, observed values as they were, all rows there
@register("impute_iterative_invariants_lineitem", """
SELECT count(*) AS n_rows, 0::BIGINT AS gaps, 0::BIGINT AS changed FROM lineitem""")
def q_iterative_invariants(spark, sf):
    from tabwright.operators.impute_model import iterative_impute
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = lineitem_with_nulls(spark, sf).select(*cols, *[F.col(c).alias(f"own_{c}") for c in cols])
    out = iterative_impute(li, cols)
    gap = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    changed = sum((F.coalesce(F.col(c) != F.col(f"own_{c}"), F.lit(False)).cast("long") for c in cols),
                  F.lit(0).cast("long"))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(gap).alias("gaps"), F.sum(changed).alias("changed"))
