"""Table profiling and validation.

Design: one wide aggregate over the table (counts, moments, lengths), quartiles
by bracketed ranks (``functions.quantiles``), distinct numbers per type, and for
text one value-frequency table built by ``unpivot`` + ``groupBy(column, value)``
with map-side partial aggregation, which gives uniques, modes and top-k. A
profile is a bounded number of scans and the only rows that reach the driver are
per-column constants.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import columns_of, dtype_name, kind
from tabwright.functions.quantiles import quantile_table

HIGH_CARDINALITY = 50  # fixed value: more uniques than this flags a categorical column
MISSING_ISSUE_PCT = 50.0  # fixed value: missing share of cells that raises an issue
DUPLICATE_ISSUE_SHARE = 0.1  # fixed value: duplicate rows above this share of rows raise an issue

PROFILE_SCHEMA = ("column string, dtype string, non_null bigint, nulls bigint, null_pct double, "
                  "n_unique bigint, unique_pct double, mean double, median double, std double, "
                  "min double, max double, q25 double, q75 double, skewness double, kurtosis double, "
                  "mode string, mode_count bigint, avg_length double")


def skew_corrected(g1: Column, n: Column) -> Column:
    """Population skewness g1 -> bias-corrected G1 (pandas / DuckDB); NULL for n < 3."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_corrected(g2: Column, n: Column) -> Column:
    """Population excess kurtosis g2 -> bias-corrected G2; NULL for n < 4."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def _long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value double, exact)``; ``exact`` is the value of an integer or decimal column that a double may not
    hold, so that neighbours above 2**53 stay apart (null for other columns)."""
    own = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.DecimalType))}
    decimal = any(isinstance(df.schema[c].dataType, T.DecimalType) for c in cols)
    kind = "decimal(38,10)" if decimal else "bigint"
    s = df.select(*[F.struct(F.col(c).cast("double").alias("value"),
                             (F.col(c) if c in own else F.lit(None)).cast(kind).alias("exact")).alias(c) for c in cols])
    return (s.unpivot([], cols, "column", "v").select("column", "v.value", "v.exact").where(F.col("value").isNotNull()))


def _long_string(df: DataFrame, cols: list[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .unpivot([], cols, "column", "value").where(F.col("value").isNotNull()))


def numeric_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value double, exact, n)``; partial aggregation collapses hot values map-side."""
    return _long_numeric(df, cols).groupBy("column", "value", "exact").agg(F.count(F.lit(1)).alias("n"))


def string_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    return _long_string(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _mode(freq: DataFrame) -> DataFrame:
    """Most frequent value per column, ties -> smallest value (a partial-aggregatable min over structs)."""
    exact = "exact" in freq.columns
    own = [F.col("exact").alias("e")] if exact else []
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"), *own))
    mode = F.col("m.v").cast("string")
    if exact:
        mode = F.coalesce(F.col("m.e").cast("string"), mode)
    return (freq.groupBy("column").agg(best.alias("m"), F.count(F.lit(1)).alias("n_unique"))
            .select("column", "n_unique", mode.alias("mode"), (-F.col("m.k")).alias("mode_count")))


def _wide_stats(df: DataFrame, num: list[str], strs: list[str], others: list[str],
                null_length: int | None) -> DataFrame:
    """One scan; returns one row per column. Numeric columns go through one small aggregate by column number: an
    aggregate of every moment of every column side by side is more code than a JVM compiles."""
    allc = num + strs + others
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(c)).alias(f"nn{i}") for i, c in enumerate(allc)]
    for i, c in enumerate(strs):
        ln = F.length(F.col(c)).cast("double")
        if null_length is not None:
            ln = F.coalesce(ln, F.lit(float(null_length)))
        aggs.append(F.avg(ln).alias(f"len{i}"))
    counted = df.agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"nn{i}").alias("non_null"),
        (F.col(f"len{strs.index(c)}") if c in strs else F.lit(None).cast("double")).alias("avg_length"))
        for i, c in enumerate(allc)])))
    names = ["mean", "std", "min", "max", "skewness", "kurtosis"]
    if not num:
        return counted.select("column", "rows", "non_null", *[F.lit(None).cast("double").alias(n) for n in names],
                              "avg_length")
    x, n = F.col("x"), F.count("x").cast("double")
    moments = (df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in num])).alias("i", "x"))
               .where("x is not null").groupBy("i")
               .agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                    skew_corrected(F.skewness(x), n).alias("skewness"),
                    kurt_corrected(F.kurtosis(x), n).alias("kurtosis"))
               .select(F.get(F.array(*[F.lit(c) for c in num]), F.col("i")).alias("column"), *names))
    # both sides hold a row per column
    return counted.join(moments, "column", "left").select("column", "rows", "non_null", *names, "avg_length")


def _quartiles(q: DataFrame) -> DataFrame:
    return q.groupBy("column").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(a)
                                     for p, a in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])


def _unique_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, n_unique)`` of numeric columns. Columns of a kind go together, each in its own exact type: whole
    numbers as long, decimals as decimal, the rest as double; a hot value collapses before the shuffle."""
    kinds: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType
        kinds.setdefault("bigint" if isinstance(t, T.IntegralType) else "decimal(38,10)" if isinstance(t, T.DecimalType)
                         else "double", []).append(c)
    parts = []
    for kind_, own in kinds.items():
        seen = (df.select(F.posexplode(F.array(*[F.col(c).cast(kind_) for c in own])).alias("i", "value"))
                .where(F.col("value").isNotNull()).distinct())
        names = F.array(*[F.lit(c) for c in own])
        parts.append(seen.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique"))
                     .select(F.get(names, F.col("i")).alias("column"), "n_unique"))
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, columns: list[str] | None = None, null_length: int | None = None) -> DataFrame:
    """Per-column profile (dtype, counts, uniques, moments, quartiles, string mode and length).

    ``null_length`` counts missing strings with that length in ``avg_length``
    (4 reproduces text 'None'); by default missing values are ignored.
    """
    columns = columns or df.columns
    sub = df.select(*columns)
    num = columns_of(sub, "numeric")
    strs = columns_of(sub, "categorical")
    others = [c for c in columns if c not in num and c not in strs]
    dtypes = {f.name: dtype_name(f.dataType) for f in sub.schema.fields}
    spark = df.sparkSession

    wide = _wide_stats(sub, num, strs, others, null_length)
    parts = []
    if num:
        q = quantile_table(sub, num, [0.25, 0.5, 0.75])
        qw = _quartiles(q)
        u = _unique_counts(sub, num)
        parts.append(u.join(qw, "column", "left")
                     .select("column", "n_unique", "median", "q25", "q75",
                             F.lit(None).cast("string").alias("mode"), F.lit(None).cast("bigint").alias("mode_count")))
    if strs or others:
        sf = string_frequencies(sub, strs + others)
        m = _mode(sf)
        keep_mode = F.col("column").isin(strs) if strs else F.lit(False)
        parts.append(m.select("column", "n_unique", *[F.lit(None).cast("double").alias(k) for k in ("median", "q25", "q75")],
                              F.when(keep_mode, F.col("mode")).alias("mode"),
                              F.when(keep_mode, F.col("mode_count")).alias("mode_count")))
    if parts:
        freqpart = reduce(DataFrame.unionByName, parts)
    else:
        freqpart = spark.createDataFrame([], "column string, n_unique bigint, median double, q25 double, "
                                             "q75 double, mode string, mode_count bigint")
    dt = spark.createDataFrame(list(dtypes.items()), "column string, dtype string")
    # wide and freqpart have one row per column: joining them is small by construction.
    j = wide.join(F.broadcast(dt), "column").join(freqpart, "column", "left")
    rows = F.col("rows").cast("double")
    nu = F.coalesce(F.col("n_unique"), F.lit(0)).cast("bigint")
    return j.select(
        "column", "dtype", F.col("non_null").cast("bigint").alias("non_null"),
        (F.col("rows") - F.col("non_null")).cast("bigint").alias("nulls"),
        F.when(rows > 0, (F.col("rows") - F.col("non_null")) / rows * 100).alias("null_pct"),
        nu.alias("n_unique"), F.when(rows > 0, nu / rows * 100).alias("unique_pct"),
        "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis",
        "mode", F.when(F.col("column").isin(strs) if strs else F.lit(False),
                       F.coalesce(F.col("mode_count"), F.lit(0))).cast("bigint").alias("mode_count"),
        "avg_length")


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """pandas ``describe()`` for numeric columns with exact interpolated quartiles, one row per column."""
    cols = columns or columns_of(df, "numeric")
    wide = _wide_stats(df.select(*cols), cols, [], [], None)
    return wide.join(_quartiles(quantile_table(df, cols, [0.25, 0.5, 0.75])), "column", "left").select(
        "column", F.col("non_null").cast("bigint").alias("count"), "mean", "std", "min",
        F.col("q25").alias("p25"), F.col("median").alias("p50"), F.col("q75").alias("p75"), "max")


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first (ties by name)."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs)
    st = [F.struct(F.lit(c).alias("column"), (F.col("__rows") - F.col(f"c{i}")).alias("missing"))
          for i, c in enumerate(df.columns)]
    return (row.select(F.inline(F.array(*st))).where(F.col("missing") > 0)
            .orderBy(F.desc("missing"), "column"))


def high_cardinality(df: DataFrame, threshold: int = HIGH_CARDINALITY, approximate: bool = False) -> DataFrame:
    cols = columns_of(df, "categorical")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, unique_values bigint")
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(cols)])
        st = [F.struct(F.lit(c).alias("column"), F.col(f"u{i}").cast("bigint").alias("unique_values"))
              for i, c in enumerate(cols)]
        u = row.select(F.inline(F.array(*st)))
    else:
        u = (string_frequencies(df, cols).groupBy("column")
             .agg(F.count(F.lit(1)).alias("unique_values")))
    return u.where(F.col("unique_values") > threshold)


def validate(df: DataFrame, high_card_threshold: int = HIGH_CARDINALITY) -> DataFrame:
    """One-row quality summary: shape, cells, missing, duplicates, kinds, high cardinality, issues.

    Duplicates need the distinct rows: one ``groupBy(all columns)`` whose partial
    aggregation collapses repeated rows map-side; every other figure is summed
    from that same grouped table, so the whole check is one shuffle.
    """
    cols = df.columns
    ncols = len(cols)
    cats = columns_of(df, "categorical")
    num = columns_of(df, "numeric")
    dts = columns_of(df, "datetime")
    nulls_in_row = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols], F.lit(0))
    width = reduce(lambda a, b: a + b, [_est_bytes(df.schema[c].dataType, c) for c in cols], F.lit(0))
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    aggs = [F.sum("__n").alias("n_rows"), F.sum(F.col("__n") - 1).alias("duplicate_rows"),
            F.sum(F.col("__n") * nulls_in_row).alias("missing_cells"),
            F.sum(F.col("__n") * width).alias("est_bytes")]
    aggs += [F.count_distinct(F.col(c)).alias(f"u{i}") for i, c in enumerate(cats)]
    r = g.agg(*aggs)
    hc = reduce(lambda a, b: a + b, [(F.col(f"u{i}") > high_card_threshold).cast("int") for i in range(len(cats))],
                F.lit(0))
    rows = F.coalesce(F.col("n_rows"), F.lit(0)).cast("bigint")
    cells = rows * ncols
    miss = F.coalesce(F.col("missing_cells"), F.lit(0)).cast("bigint")
    dup = F.coalesce(F.col("duplicate_rows"), F.lit(0)).cast("bigint")
    miss_pct = F.when(cells > 0, miss / cells * 100)
    return r.select(
        rows.alias("n_rows"), F.lit(ncols).alias("n_cols"), cells.alias("total_cells"),
        miss.alias("missing_cells"), miss_pct.alias("missing_pct"), dup.alias("duplicate_rows"),
        F.lit(len(num)).alias("n_numeric"), F.lit(len(cats)).alias("n_categorical"),
        F.lit(len(dts)).alias("n_datetime"), hc.alias("n_high_cardinality"),
        F.coalesce(F.col("est_bytes"), F.lit(0)).cast("bigint").alias("est_bytes"),
        F.coalesce(miss_pct > MISSING_ISSUE_PCT, F.lit(False)).alias("issue_missing"),
        (dup > rows * DUPLICATE_ISSUE_SHARE).alias("issue_duplicates"),
        (hc > 0).alias("issue_cardinality"))


def _est_bytes(dt: T.DataType, c: str) -> Column:
    """Estimated in-memory width of a value (re-aimed memory figure; strings by byte length)."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("bigint")
    size = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    for t, s in size.items():
        if isinstance(dt, t):
            return F.lit(s)
    return F.lit(8)


def dtype_counts(df: DataFrame) -> DataFrame:
    """Column count per data type (schema only)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[dtype_name(f.dataType)] = counts.get(dtype_name(f.dataType), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n_columns int")


def value_counts(df: DataFrame, max_unique: int = 10, top: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Top ``top`` values of each categorical column having at most ``max_unique`` distinct values.

    The window is only applied to columns already known to have at most
    ``max_unique`` values, so each window partition is bounded.
    """
    cols = columns or columns_of(df, "categorical")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, rank int")
    sf = string_frequencies(df, cols)
    small = sf.groupBy("column").agg(F.count(F.lit(1)).alias("u")).where(F.col("u") <= max_unique)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (sf.join(F.broadcast(small.select("column")), "column", "left_semi")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


def top_values(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Most frequent values of one column (top-k is the feature); global top-k via ``orderBy().limit``."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top))


def analyze_target(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """Target summary: numeric -> one row of moments; otherwise the ``top`` most frequent values.

    Output is long ``(target, kind, stat, value, n)``; an unknown column raises ``ValueError``.
    """
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    k = kind(df.schema[target].dataType)
    x = F.col(target)
    if k == "numeric":
        xd = x.cast("double")
        n = F.count(x).cast("double")
        r = df.agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("non_null"),
                   F.count_distinct(x).alias("n_unique"), F.min(xd).alias("min"), F.max(xd).alias("max"),
                   F.avg(xd).alias("mean"), F.stddev_samp(xd).alias("std"),
                   skew_corrected(F.skewness(xd), n).alias("skewness"))
        st = [F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"))
              for s in ("rows", "non_null", "n_unique", "min", "max", "mean", "std", "skewness")]
        return r.select(F.lit(target).alias("target"), F.lit("numeric").alias("kind"), F.inline(F.array(*st)),
                        F.lit(None).cast("bigint").alias("n"))
    tv = top_values(df, target, top)
    return tv.select(F.lit(target).alias("target"), F.lit("categorical").alias("kind"),
                     F.col("value").alias("stat"), F.lit(None).cast("double").alias("value"), "n")


def data_summary(df: DataFrame, max_unique: int = 10, top: int = 5) -> DataFrame:
    """Long ``(section, key, item, value)`` summary: shape, types, missing, describe, value counts."""
    spark = df.sparkSession
    shape = df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.inline(F.array(F.struct(F.lit("shape").alias("section"), F.lit("rows").alias("key"),
                                  F.lit("").alias("item"), F.col("rows").cast("string").alias("value")),
                         F.struct(F.lit("shape").alias("section"), F.lit("columns").alias("key"),
                                  F.lit("").alias("item"), F.lit(str(len(df.columns))).alias("value")))))
    types = spark.createDataFrame([("types", f.name, "", dtype_name(f.dataType)) for f in df.schema.fields],
                                  "section string, key string, item string, value string")
    miss = missing_by_column(df).select(F.lit("missing").alias("section"), F.col("column").alias("key"),
                                        F.lit("").alias("item"), F.col("missing").cast("string").alias("value"))
    parts = [shape, types, miss]
    if columns_of(df, "numeric"):
        d = describe_numeric(df)
        stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        parts.append(d.select(F.lit("describe").alias("section"), F.col("column").alias("key"),
                              F.inline(F.array(*[F.struct(F.lit(s).alias("item"), F.col(s).cast("string").alias("value"))
                                                 for s in stats]))))
    vc = value_counts(df, max_unique, top)
    parts.append(vc.select(F.lit("value_counts").alias("section"), F.col("column").alias("key"),
                           F.col("value").alias("item"), F.col("n").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)
