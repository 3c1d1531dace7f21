"""Column-name cleaning (pure name logic plus one ``toDF``)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def clean_name(name: str) -> str:
    s = name.strip().lower().replace(" ", "_")
    s = re.sub(r"[^a-zA-Z0-9_]", "", s)
    s = re.sub(r"_+", "_", s).strip("_")
    if not s:
        s = "col"
    if s[0].isdigit():
        s = "col_" + s
    return s


def clean_names(names: list[str]) -> list[str]:
    """Clean each name; repeats get _1, _2, ... (the first keeps its name).

    Suffixes are chosen so that they never collide with another cleaned name.
    """
    base = [clean_name(n) for n in names]
    taken = set(base)
    seen: dict[str, int] = {}
    out = []
    for b in base:
        if b not in seen:
            seen[b] = 0
            out.append(b)
            continue
        i = seen[b]
        while True:
            i += 1
            cand = f"{b}_{i}"
            if cand not in taken:
                break
        seen[b] = i
        taken.add(cand)
        out.append(cand)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))
