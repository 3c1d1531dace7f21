"""Oracle SQL text (DuckDB dialect) for the registered queries.

These strings are the independent reference implementation each Spark query is
checked against; they are written per operator, not derived from Spark plans.
"""

from __future__ import annotations

R = 6


def rnd(expr: str, d: int = R) -> str:
    return f"round(CAST({expr} AS DOUBLE), {d})"


def profile_sql(src: str, cols: list[tuple[str, str, str]]) -> str:
    """cols: (name, spark dtype, kind) with kind in numeric/categorical/other."""
    parts = []
    for c, dt, k in cols:
        base = (f"SELECT '{c}' AS \"column\", '{dt}' AS dtype, count({c}) AS non_null, "
                f"count(*) - count({c}) AS nulls, {rnd(f'100.0::DOUBLE * (count(*) - count({c})) / count(*)')} AS null_pct, "
                f"count(DISTINCT {c}) AS n_unique, {rnd(f'100.0::DOUBLE * count(DISTINCT {c}) / count(*)')} AS unique_pct")
        if k == "numeric":
            x = f"CAST({c} AS DOUBLE)"
            base += (f", {rnd(f'avg({x})')} AS mean, {rnd(f'quantile_cont({x}, 0.5)')} AS median, "
                     f"{rnd(f'stddev_samp({x})')} AS std, {rnd(f'min({x})')} AS min, {rnd(f'max({x})')} AS max, "
                     f"{rnd(f'quantile_cont({x}, 0.25)')} AS q25, {rnd(f'quantile_cont({x}, 0.75)')} AS q75, "
                     f"{rnd(f'skewness({x})')} AS skewness, {rnd(f'kurtosis({x})')} AS kurtosis, "
                     f"NULL::VARCHAR AS mode, NULL::BIGINT AS mode_count, NULL::DOUBLE AS avg_length")
        elif k == "categorical":
            base += (", NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, "
                     "NULL::DOUBLE AS max, NULL::DOUBLE AS q25, NULL::DOUBLE AS q75, NULL::DOUBLE AS skewness, "
                     "NULL::DOUBLE AS kurtosis, "
                     f"(SELECT {c} FROM src WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, "
                     f"coalesce((SELECT count(*) FROM src WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), 0) AS mode_count, "
                     f"{rnd(f'avg(length({c}))')} AS avg_length")
        else:
            base += (", NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, "
                     "NULL::DOUBLE AS max, NULL::DOUBLE AS q25, NULL::DOUBLE AS q75, NULL::DOUBLE AS skewness, "
                     "NULL::DOUBLE AS kurtosis, NULL::VARCHAR AS mode, NULL::BIGINT AS mode_count, "
                     "NULL::DOUBLE AS avg_length")
        parts.append(base + " FROM src")
    return f"WITH src AS ({src}) " + " UNION ALL ".join(parts)
