"""Storage-type advice and its application.

One wide aggregate answers every per-column question (does every value parse
as a number / integer / timestamp? min, max, float32-lossless?), plus the
string frequency table for unique counts. ``try_cast`` is mandatory: ANSI mode
makes plain casts raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.operators.profile import string_frequencies

CATEGORY_RATIO = 0.1  # fixed value: unique/rows below this advises 'category'
FLOAT32_MAX = 3.4028234663852886e38  # fixed value: largest finite float32

# Unsigned and signed integer ladders (label, lower, upper).
UNSIGNED = [("uint8", 255), ("uint16", 65535), ("uint32", 4294967295)]
SIGNED = [("int8", -128, 127), ("int16", -32768, 32767), ("int32", -2147483648, 2147483647)]
SPARK_INT = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]

# Other Spark types, reported in the pandas vocabulary and left unchanged.
PASSTHROUGH = {"int": "int32", "smallint": "int16", "tinyint": "int8", "float": "float32", "boolean": "bool",
               "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]"}

ADVICE_SCHEMA = "column string, dtype string, advice string, spark_type string, lossless boolean"


def _int_advice(mn, mx):
    if mn is None:
        return "int64", "bigint"
    if mn >= 0:
        label = next((l for l, hi in UNSIGNED if mx <= hi), "uint64")
    else:
        label = next((l for l, lo, hi in SIGNED if mn >= lo and mx <= hi), "int64")
    st = next((t for t, lo, hi in SPARK_INT if mn >= lo and mx <= hi), "bigint")
    return label, st


def suggest_types(df: DataFrame, category_ratio: float = CATEGORY_RATIO) -> DataFrame:
    fields = df.schema.fields
    strs = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            d = c.try_cast("double")
            aggs += [F.coalesce(F.bool_and(c.isNull() | d.isNotNull()), F.lit(True)).alias(f"num{i}"),
                     F.coalesce(F.bool_and(c.isNull() | (d == F.floor(d))), F.lit(True)).alias(f"int{i}"),
                     F.coalesce(F.bool_and(c.isNull() | c.try_cast("timestamp").isNotNull()), F.lit(True)).alias(f"ts{i}")]
        elif isinstance(f.dataType, (T.LongType, T.DoubleType)):
            aggs += [F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}")]
            if isinstance(f.dataType, T.DoubleType):
                aggs.append(F.coalesce(F.bool_and(c.isNull() | (c.cast("float").cast("double") == c)),
                                       F.lit(True)).alias(f"ll{i}"))
    r = df.agg(*aggs).first()
    uniq = {}
    if strs:
        uniq = {x["column"]: x["u"] for x in string_frequencies(df, strs).groupBy("column")
                .agg(F.count(F.lit(1)).alias("u")).collect()}
    rows = r["__rows"]
    out = []
    for i, f in enumerate(fields):
        dt = f.dataType.simpleString()
        lossless = None
        if isinstance(f.dataType, T.StringType):
            if r[f"num{i}"]:
                adv, st = ("int64", "bigint") if r[f"int{i}"] else ("float64", "double")
            elif r[f"ts{i}"]:
                adv, st = "datetime64[ns]", "timestamp_ntz"
            elif rows and uniq.get(f.name, 0) / rows < category_ratio:
                adv, st = "category", "string"
            else:
                adv, st = "object", "string"
        elif isinstance(f.dataType, T.LongType):
            adv, st = _int_advice(r[f"mn{i}"], r[f"mx{i}"])
        elif isinstance(f.dataType, T.DoubleType):
            mn, mx = r[f"mn{i}"], r[f"mx{i}"]
            fits = mn is not None and mn >= -FLOAT32_MAX and mx <= FLOAT32_MAX
            adv, st = ("float32", "float") if fits else ("float64", "double")
            lossless = bool(r[f"ll{i}"])
        else:
            adv, st = PASSTHROUGH.get(dt, "object"), dt
        out.append((f.name, dt, adv, st, lossless))
    return df.sparkSession.createDataFrame(out, ADVICE_SCHEMA)


def apply_types(df: DataFrame, advice: DataFrame | dict[str, str]) -> DataFrame:
    """Cast columns to the advised Spark types with ``try_cast`` (integer text is read exactly, other numbers through double)."""
    if isinstance(advice, DataFrame):
        advice = {r["column"]: r["spark_type"] for r in advice.select("column", "spark_type").collect()}
    cols = []
    for f in df.schema.fields:
        st = advice.get(f.name)
        c = F.col(f.name)
        if st is None or st == f.dataType.simpleString():
            cols.append(c)
        elif isinstance(f.dataType, T.StringType) and st in ("tinyint", "smallint", "int", "bigint"):
            # text of a whole number is read exactly; "1.0" and "1e3" go through double
            cols.append(F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
                        .try_cast(st).alias(f.name))
        else:
            cols.append(c.try_cast(st).alias(f.name))
    return df.select(*cols)
