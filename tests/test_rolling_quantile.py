"""Quantiles between values that are next to each other fall to the same side as in SQL, in rolling windows and over whole series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import states
from tessera.plans.cube import dense

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def cells():
    """40 series of up to 12 values, most of which differ by the last bits; some are missing."""
    rng, rows = random.Random(3), []
    for x in range(40):
        base = rng.randrange(100, 20000) / 100
        for day in range(12):
            value = base if rng.random() < 0.8 else rng.randrange(100, 20000) / 100
            for _ in range(rng.randrange(3)):
                value = math.nextafter(value, 1e9)
            rows.append((day, x, None if rng.random() < 0.2 else value))
    return rows


@pytest.mark.parametrize("q", [0.75, 0.9, 0.3])
@pytest.mark.parametrize("window", [7, None])
def test_quantiles_are_those_of_sql(spark, cells, window, q):
    df = spark.createDataFrame(cells, "d int, x int, value double").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("time"), F.lit(0).alias("y"), "x", "value")
    out = states.quantile_state(dense(df), q, rolling_window=window).df.select(F.datediff("time", F.lit("2024-01-01").cast("date")).alias("d"), "x", "state", "threshold")
    con = duckdb.connect()
    con.execute("CREATE TABLE c (d INTEGER, x INTEGER, value DOUBLE)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", [list(r) for r in cells])
    over = f"ORDER BY d ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW" if window else ""
    sql = con.execute(f"SELECT d, x, coalesce(value >= q, false), q FROM (SELECT *, quantile_cont(value, {q}) OVER (PARTITION BY x {over}) AS q FROM c)").fetchall()
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, sql))


def test_fused_product(spark):
    """Also where the splitting overflows, and with missing values."""
    from tessera.functions.stats import fused

    rng = random.Random(5)
    rows = [(rng.uniform(-200, 200), rng.random(), rng.uniform(-200, 200)) for _ in range(300)]
    rows += [(1e305, 0.25, 1.0), (math.inf, 0.25, 1.0), (1.0, 0.5, -math.inf), (None, 0.5, 1.0), (0.0, 0.5, 0.0)]
    found = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double").coalesce(1).select(fused(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert found == [None if a is None else math.fma(a, b, c) for a, b, c in rows]
