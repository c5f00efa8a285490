"""Nearest elements of an axis: by halving, and as a scan of all elements would choose."""

import math
import random

from pyspark.sql import functions as F

from tessera.operators.align import nearest


def test_nearest_equals_a_scan_and_does_not_scan(spark):
    rng = random.Random(3)
    cases = [([], 1.0), ([5.0], None), ([1.0, 3.0], 2.0), ([1.0, 2.0, 3.0], 1e300), ([-1.0, 4.0], math.inf), ([-1.0, 4.0], math.nan), ([0.0, math.inf], 7.0)]
    for n in (1, 2, 3, 8, 31):
        axis = sorted({float(rng.randrange(-40, 40)) for _ in range(n)})
        cases += [(axis, rng.randrange(-100, 100) / 2) for _ in range(12)]
    df = spark.createDataFrame(cases, "a array<double>, v double")
    scan = F.array_min(F.transform("a", lambda c: F.struct(F.abs(c - F.col("v")).alias("d"), c.alias("c"))))["c"]
    rows = df.select(nearest("a", F.col("v")).alias("got"), scan.alias("want")).collect()
    assert [repr(r["got"]) for r in rows] == [repr(r["want"]) for r in rows]
    plan = df.select(nearest("a", F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan
