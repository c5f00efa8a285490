"""Lake tables, keys, population features and models."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.lake import keys, tables
from tessera.ml import models
from tessera.operators import population


def test_keys_are_stable_and_chained():
    assert keys.stable_json({"b": [1, None], "a": 1.5}) == '{"a":1.5,"b":[1,null]}'
    g = keys.geometry_key("f1", "abc", "v1")
    assert g.startswith("geometry:") and len(g) == len("geometry:") + 24 and g != keys.geometry_key("f1", "abd", "v1")
    c = [keys.climate_key("f1", g, "s", v, "daily", "v1") for v in (["a", "b"], ["b", "a"])]
    assert c[0] == c[1] and keys.vase_key("f1", g, c[0], "v1", {}) != keys.vase_key("f2", g, c[0], "v1", {})


def test_key_columns_equal_python(spark):
    ids = ['f"1', "a\\b", "x y"]
    df = spark.createDataFrame([(i,) for i in ids], "fire_id string")
    col = keys.key_column("geometry", {"fire_id": F.col("fire_id")}, {"geometry": "v1"}, {"method": "canonical_fire_time_geometry", "source_geometry_hash": "h"})
    assert {r["fire_id"]: r["k"] for r in df.select("fire_id", col.alias("k")).collect()} == {i: keys.geometry_key(i, "h", "v1") for i in ids}


def test_what_a_change_invalidates():
    assert keys.invalidated(["traits"]) == ("traits", "vase", "render") and keys.invalidated(["render"]) == ("render",)
    assert keys.invalidated([]) == () and keys.invalidated(["source", "vase"]) == keys.COMPONENTS
    with pytest.raises(ValueError):
        keys.invalidated(["nothing"])


def test_partitions(spark, tmp_path):
    df = spark.createDataFrame([(2020, -105.2, 40.1, 1)], "year int, lon double, lat double, v int")
    out = tables.with_partitions(df, "lon", "lat", "pv/1")
    assert out.select("region", "spatial_bucket", "processing_version").first() == ("intermountain", "n040_w0106", "pv_1")
    tables.write_table(out, str(tmp_path / "t"))
    assert (tmp_path / "t/year=2020/region=intermountain/spatial_bucket=n040_w0106/processing_version=pv_1").is_dir()
    assert tables.partition_path("fire_time", 2020, "west", "n040_w0106", "a/b").endswith("processing_version=a_b")
    with pytest.raises(ValueError):
        tables.partition_path("by_fire_id", 2020, "west", "b", "v")


def test_schemas(spark):
    assert len(tables.TABLES) == 13
    for t in tables.TABLES:
        assert set(tables.primary_key(t)) <= set(tables.required(t)) and tables.schema_errors(tables.empty(spark, t), t) == []
    bad = spark.createDataFrame([("f", "x")], "fire_id string, time_index string")
    assert "time_index is string, not bigint" in tables.schema_errors(bad, "fire_time") and "missing year" in tables.schema_errors(bad, "fire_time")
    rows = spark.createDataFrame([("a", "r"), ("a", "r"), (None, "r")], "fire_id string, run_id string")
    assert tables.row_errors(rows, "processing_manifest").count() == 3


def test_states_of_a_run(spark):
    pairs = [(a, b) for a in tables.STATES for b in tables.STATES]
    got = {(r["a"], r["b"]) for r in spark.createDataFrame(pairs, "a string, b string").where(tables.allowed(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b) for a, after in tables.NEXT.items() for b in after.split()} | {(a, "failed") for a in tables.STATES if a not in ("published", "failed")}
    m = spark.createDataFrame([("1", "r", "pending", 0, None), ("2", "r", "published", 1, None), ("3", "r", "failed", 2, "x")], "fire_id string, run_id string, status string, attempts int, failure_reason string")
    asked = spark.createDataFrame([("1", "r", "running", None), ("2", "r", "failed", "y"), ("3", "r", "pending", None)], "fire_id string, run_id string, new_status string, reason string")
    out = {r["fire_id"]: (r["status"], r["attempts"], r["failure_reason"], r["rejected"]) for r in tables.transitions(m, asked).collect()}
    assert out == {"1": ("running", 1, None, False), "2": ("published", 1, None, True), "3": ("pending", 2, None, False)}


def test_quality_flags(spark):
    df = spark.createDataFrame([(94, 100), (97, 100), (100, 100), (1, 0)], "o int, e int").select("o", tables.climate_flags(F.col("o"), F.col("e"), "tmmx").alias("f"))
    out = {r["o"]: (r["f"], r["p"]) for r in df.withColumn("p", tables.climate_passed(F.col("f"))).collect()}
    assert out == {94: (["tmmx_missing_gt_5pct"], False), 97: (["tmmx_missing_le_5pct"], True), 100: ([], True), 1: (["invalid_expected_steps"], True)}


def test_cohort_medoid_and_quantiles(spark):
    t = spark.createDataFrame([("a", "west", 10.0, 12.0), ("b", "west", 11.0, 13.0), ("c", "east", 80.0, 5.0)], "fire_id string, region string, p double, q double")
    assert {r["fire_id"] for r in tables.cohort(t, region="west", p=lambda c: c > 5).collect()} == {"a", "b"}
    assert tables.medoid(t.where("region = 'west'"), "fire_id", ["p", "q"]).first()["fire_id"] == "a"
    s = spark.createDataFrame([(-1, 10.0), (-1, 20.0), (0, 1.0), (0, None)], "event_offset_hours int, temp double")
    out = {r["event_offset_hours"]: r for r in tables.aligned_quantiles(s, "temp", "event_offset_hours").collect()}
    assert (out[-1]["q50"], out[-1]["count"], out[-1]["q10"], out[-1]["q90"]) == (15.0, 2, 10.0, 20.0) and out[0]["count"] == 1


def test_manifest_split(spark):
    s = spark.createDataFrame([(1, True), (1, True), (2, True), (2, False)], "fire_id int, climate_available boolean")
    asked = spark.createDataFrame([(1, 2001), (2, 2001), (3, 2004)], "fire_id int, year int")
    done, failed = tables.manifest_split(s, asked, [2001])
    assert [r["fire_id"] for r in done.collect()] == [1]
    assert {(r["fire_id"], r["failure_reason"]) for r in failed.collect()} == {(2, "climate_missing"), (3, "unsupported_year")}


def brute_features(growth):
    g, n = np.array(growth, float), len(growth)
    final, cum = g.sum(), np.cumsum(growth)
    at = lambda v, q: float(np.interp(q, np.linspace(0, 1, n), v)) if n > 1 else float(v[0])
    active = g >= max(np.quantile(g, 0.75), g.max() / 4, 1e-9)
    p = g[g > 0] / final
    return {
        "pulse_count": int((active & ~np.concatenate([[False], active[:-1]])).sum()) if g.max() > 0 else 0,
        "peak_timing": int(g.argmax()) / max(n - 1, 1),
        "front_loaded_fraction": at(cum / final, 0.5),
        "growth_entropy": float(-(p * np.log(p)).sum() / math.log(max(n, 2))),
        "width_at_half": at(np.sqrt(cum / final), 0.5),
        "growth_p03": at(g / final, 0.3),
    }


def test_features_equal_numpy(spark):
    series = {1: [5.0], 2: [1.0, 9.0, 0.0, 0.0, 7.0, 2.0], 3: [3.0, 3.0, 3.0], 4: np.random.default_rng(0).random(20).tolist()}
    rows = [(k, i, f"2020-01-{i + 1:02d}", v) for k, g in series.items() for i, v in enumerate(g)]
    growth = spark.createDataFrame(rows, "id int, i int, day string, a double").withColumn("day", F.to_date("day"))
    s = population.slices_from_growth(growth, "id", ["day"], "day", "a")
    traits = growth.groupBy(F.col("id").alias("fire_id")).agg(F.lit(2020).alias("year"), F.lit("west").alias("region"), F.sum("a").alias("total_area_km2"), F.count("a").alias("duration_days"), F.max("a").alias("peak_growth_km2_per_day"))
    out = {r["fire_id"]: r for r in population.features(s, traits).collect()}
    for k, g in series.items():
        for name, want in brute_features(g).items():
            assert abs(out[k][name] - want) < 1e-9, (k, name)
    labels = {r["fire_id"]: r["shape_label"] for r in population.shape_labels(population.features(s, traits)).collect()}
    assert labels[1] == "single flash"


def test_principal_components_equal_svd(spark):
    x = np.random.default_rng(1).normal(size=(200, 4)) @ np.diag([3, 1, 0.5, 0.2])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    z = (x - np.median(x, axis=0)) / x.std(axis=0)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    shares, loadings = models.pca(df, ["a", "b", "c", "d"], 4)
    assert np.allclose(shares, s / s.sum()) and np.allclose(loadings.T @ loadings, np.eye(4))


def test_blocked_regression_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x, block = rng.normal(size=(120, 2)), rng.integers(0, 3, 120)
    y = x @ [1.0, -2.0] + rng.normal(size=120) + block
    df = spark.createDataFrame([(float(a), float(b), float(v), f"b{k}") for (a, b), v, k in zip(x, y, block, strict=True)], "p double, q double, y double, blk string")
    for alpha in (0.0, 5.0):
        out = {r["block"]: r["r2"] for r in models.blocked_cv(df, ["p", "q"], "y", "blk", alpha).collect()}
        for k in range(3):
            a, t = np.c_[np.ones(120), x], block == k
            beta = np.linalg.solve(a[~t].T @ a[~t] + alpha * np.diag([0, 1, 1]), a[~t].T @ y[~t])
            assert abs(out[f"b{k}"] - (1 - ((y[t] - a[t] @ beta) ** 2).sum() / ((y[t] - y[t].mean()) ** 2).sum())) < 1e-8


def test_ward_and_farthest(spark):
    pts = np.array([[0, 0], [0, 1], [10, 0], [10, 1], [5, 50]], float)
    assert models.ward(pts, 3).tolist() == [0, 0, 1, 1, 2] and models.silhouette(pts, models.ward(pts, 3)) > 0.6
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double")
    assert set(models.farthest_first(df, "id", ["a", "b"], 3)) >= {4}


def test_stable_json_is_json():
    assert json.loads(keys.stable_json({"a": {"c": 1, "b": [True]}})) == {"a": {"b": [True], "c": 1}}
