"""All pairs are made by many tasks, however few the pixels."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import synchrony
from tessera.plans.cube import dense


def test_all_pairs_are_dealt_to_tasks(spark):
    cells = spark.range(120).select(F.lit("2024-01-01").cast("date").alias("time"), (F.col("id") % 10).alias("y"), F.floor(F.col("id") / 10).alias("x"), F.lit(1.0).alias("value"))
    pairs = synchrony.spatial_pairs(dense(cells), "all_pairs").select("source", "target", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["source"], r["target"]) for r in pairs) == [(a, b) for a in range(120) for b in range(a + 1, 120)]
    tasks = np.bincount([r["task"] for r in pairs])
    assert (tasks > 0).sum() >= 8 and tasks.max() < len(pairs) / 3


def test_rows_of_all_pairs_recur_near_enough_to_be_compressed(spark, tmp_path):
    """Source by source, with targets in any order, a row takes 2.8 bytes here."""
    cells = spark.range(1203).select(F.lit("2024-01-01").cast("date").alias("time"), (F.col("id") % 5).alias("y"), F.floor(F.col("id") / 5).alias("x"), F.lit(1.0).alias("value"))
    synchrony.spatial_pairs(dense(cells), "all_pairs").select("source", "target", "target_y", "target_x", "distance").write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    n = 1203 * 1202 // 2
    assert found.where("source < target AND source >= 0 AND target < 1203").select("source", "target").distinct().count() == found.count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2 * n
