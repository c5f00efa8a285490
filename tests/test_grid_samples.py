"""Samples of a grid on each day: the same as of single cells, and no cell becomes a row."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries_lake, queries_more  # noqa: F401
from tessera.operators import geometry


def _blob(rng, corners):
    """A ring around a place near the origin, not always convex; some vertices lie on the grid."""
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    cx, cy = rng.choice([-1, 0, 2]), rng.choice([0, 1])
    return [{"x": float(round(cx + rng.uniform(0.3, 4) * math.cos(t), rng.choice([0, 3]))), "y": float(round(cy + rng.uniform(0.3, 4) * math.sin(t), rng.choice([0, 3])))} for t in at]


def test_grid_samples_equal_samples_of_cells(spark):
    rng, day = random.Random(5), dt.date(2024, 1, 1)
    rings = [(e, day + dt.timedelta(days=3 * i), None if i == 2 else _blob(rng, rng.choice([3, 4, 7]))) for e in range(12) for i in range(e % 5 + 1)]
    perimeters = spark.createDataFrame(rings, f"event_id long, time date, ring {geometry.RING}")
    days = spark.createDataFrame([(e, day + dt.timedelta(days=d)) for e in range(13) for d in range(-1, 16)], "event_id long, time date")
    grid = spark.range(-4, 6).select(F.col("id").alias("y")).crossJoin(spark.range(-4, 7).select(F.col("id").alias("x")))
    amount = (F.col("y") * F.col("x") + F.col("event_id") % 3).cast("double")
    cells = days.crossJoin(grid).withColumn("value", F.when((F.col("x") + F.col("y")) % 4 != 0, amount))
    value = lambda d, y, x: np.where((x + y) % 4 != 0, y * x + d["event_id"] % 3, np.nan)
    found = [sorted(map(tuple, df.collect())) for df in (geometry.climate_samples(cells, perimeters, ["event_id"], 0.5, "value"), geometry.climate_samples_on_grid(days, perimeters, ["event_id"], 0.5, grid, value))]
    assert len(found[0]) == len(found[1]) > 50 and any(r[3] and r[5] for r in found[0])
    for a, b in zip(*found, strict=True):
        assert a[:2] == b[:2] and (a[3], a[5]) == (b[3], b[5]) and a[2] == pytest.approx(b[2]) and a[4] == pytest.approx(b[4])


def test_climate_samples_makes_no_row_of_a_cell(spark, tmp_path):
    rows = [(1, k, dt.datetime(2024, 1, 1 + 2 * k), 1000.0 + k) for k in range(9)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    out = queries_lake.QUERIES["climate_samples"](spark, str(tmp_path))
    assert out.count() > 0 and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
