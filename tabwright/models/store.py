"""Fitted objects in a folder that Spark's file system can reach.

``save`` writes one JSON tree (Spark text file ``tree``) in which arrays, tuples, fitted objects, Spark ML models and
DataFrames are marked; models and DataFrames go to numbered folders beside it through their own Spark writers. Only
dataclasses of this package and Spark ML models are read back, no code is stored.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import fields, is_dataclass

import numpy as np
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession

PACKAGE = __name__.split(".")[0]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save(spark: SparkSession, obj, path: str) -> None:
    path, parts = path.rstrip("/"), []

    def part() -> str:
        parts.append(f"part-{len(parts)}")
        return parts[-1]

    def tree(x):
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, np.ndarray):
            return {"@array": x.tolist(), "dtype": str(x.dtype)}
        if isinstance(x, DataFrame):
            p = part()
            x.write.mode("overwrite").parquet(f"{path}/{p}")
            return {"@table": p}
        if isinstance(x, MLWritable):
            p = part()
            x.write().overwrite().save(f"{path}/{p}")
            return {"@ml": p, "class": f"{type(x).__module__}.{type(x).__name__}"}
        if is_dataclass(x):
            return {"@object": f"{type(x).__module__}.{type(x).__name__}",
                    "fields": {f.name: tree(getattr(x, f.name)) for f in fields(x)}}
        if isinstance(x, dict):
            return {"@dict": [[tree(k), tree(v)] for k, v in x.items()]}
        if isinstance(x, tuple):
            return {"@tuple": [tree(v) for v in x]}
        if isinstance(x, list):
            return [tree(v) for v in x]
        raise TypeError(f"can't store {type(x).__name__}")

    text = json.dumps(tree(obj))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/tree")


def load(spark: SparkSession, path: str):
    path = path.rstrip("/")

    def class_of(name: str, package: str):
        module, _, cls = name.rpartition(".")
        if module.split(".")[0] != package.split(".")[0] or not f"{module}.".startswith(f"{package}."):
            raise ValueError(f"not a class of {package}: {name}")
        return getattr(importlib.import_module(module), cls)

    def back(x):
        if isinstance(x, list):
            return [back(v) for v in x]
        if not isinstance(x, dict):
            return x
        if "@array" in x:
            return np.array(x["@array"], dtype=x["dtype"])
        if "@table" in x:
            return spark.read.parquet(f"{path}/{x['@table']}")
        if "@ml" in x:
            return class_of(x["class"], "pyspark.ml").load(f"{path}/{x['@ml']}")
        if "@object" in x:
            cls = class_of(x["@object"], PACKAGE)
            if not is_dataclass(cls):
                raise ValueError(f"not a stored class: {x['@object']}")
            return cls(**{k: back(v) for k, v in x["fields"].items()})
        if "@tuple" in x:
            return tuple(back(v) for v in x["@tuple"])
        return {back(k): back(v) for k, v in x["@dict"]}

    return back(json.loads(spark.read.text(f"{path}/tree", wholetext=True).first()["value"]))
