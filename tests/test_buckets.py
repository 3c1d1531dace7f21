import math

import numpy as np


def test_bucket_of_a_value_is_found_by_halving(spark):
    """As by counting the bounds below a value; the plan doesn't go through all bounds for every row."""
    from pyspark.sql import functions as F

    from tabwright.operators import knn as K
    x = np.round(np.random.default_rng(2).exponential(3.0, 3000), 2)
    r = spark.createDataFrame([(float(v),) for v in x], "x double")
    bucket, n = K._bucketizer(r, "x", 20)
    asked = [*map(float, x[:500]), -1.0, 0.0, 1e9, math.inf, -math.inf, math.nan, None]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(asked)], "i int, v double").select(
        "i", "v", bucket(F.col("v")).alias("b"))
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = [r_["b"] for r_ in sorted(out.collect())]
    counts = np.bincount(r.select(bucket(F.col("x")).alias("b")).toPandas()["b"], minlength=n)
    assert counts.sum() == 3000 and counts.max() < 200 and n >= 100
    known = [(v, b) for v, b in zip(asked, got) if v is not None and not math.isnan(v)]
    known.sort()
    assert all(a[1] <= b[1] for a, b in zip(known, known[1:]))  # monotone
    assert got[-1] == 0 and got[-3] == 0 and got[-4] == got[-5] == n - 1 and got[500] == 0
