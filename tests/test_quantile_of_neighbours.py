"""A quantile between two values that are next to each other is one of them, as in SQL."""

from pyspark.sql import functions as F

from tessera.operators import states
from tessera.plans.cube import dense


def test_quantile_between_next_doubles(spark):
    low, high = 60.89999999999999, 60.9
    rows = [(k, v) for k, v in enumerate([1.0, high, None, low, 2.0])]
    cells = spark.createDataFrame(rows, "d int, value double").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("time"), F.lit(0).alias("y"), F.lit(0).alias("x"), "value")
    out = {r["value"]: r["state"] for r in states.quantile_state(dense(cells), 0.75).df.select("state", (F.col("magnitude") + F.col("threshold")).alias("value")).collect()}
    assert out[low] and out[high] and not out[1.0] and not out[2.0] and not out[None]
