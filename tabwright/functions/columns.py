"""Column kinds, NaN normalisation, row keys and hash-based draws.

Row identity never relies on order: samples, splits and folds hash a key made
of the row's own values (md5), so they are stable under repartitioning, survive
task retries, and can be reproduced by any SQL engine with ``md5``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, DATETIME):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def columns_of(df: DataFrame, k: str, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) == k and f.name not in exclude]


def select_kinds(df: DataFrame, kinds: list[str] | str = "all", target: str | None = None) -> DataFrame:
    """Columns of the kinds asked for (``numeric``, ``categorical``, ``datetime``, ``boolean``, ``other`` or ``all``), in
    their order; the target, whatever its kind, comes last."""
    wanted = None if kinds == "all" else {kinds} if isinstance(kinds, str) else set(kinds)
    cols = [f.name for f in df.schema.fields if f.name != target and (wanted is None or kind(f.dataType) in wanted)]
    if target is not None and target not in df.columns:
        raise ValueError(f"target {target!r} not in the table")
    return df.select(*cols, *([target] if target is not None else []))


def dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def normalize_nan(df: DataFrame) -> DataFrame:
    """Float NaN becomes NULL so that 'missing' is one concept (as in pandas)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def key_text(cols: list[str]) -> Column:
    """Text form of a row key: integers/strings joined by '|' (doubles excluded by caller)."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def md5_unit(cols: list[str], seed: int) -> Column:
    """Hash of key||'|'||seed as a 32-bit integer from the first 8 hex digits of md5."""
    h = F.md5(F.concat(key_text(cols), F.lit(f"|{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def md5_order(cols: list[str], seed: int) -> Column:
    return F.md5(F.concat(key_text(cols), F.lit(f"|{seed}")))


def sql_key_text(cols: list[str]) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(cast({c} as varchar), '')" for c in cols) + ")"


def sql_md5_unit(cols: list[str], seed: int) -> str:
    return f"('0x' || substr(md5({sql_key_text(cols)} || '|{seed}'), 1, 8))::bigint"


def sql_md5_order(cols: list[str], seed: int) -> str:
    return f"md5({sql_key_text(cols)} || '|{seed}')"
