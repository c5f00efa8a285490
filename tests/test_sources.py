"""Areas, cube sources and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry
from tessera.sources import aoi, catalogs, cubes
from tessera.streaming import cubes as streams


def test_areas():
    assert aoi.area(point=(10.0, 20.0)) == aoi.Box(9.95, 19.95, 10.05, 20.05)
    ring = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 2], [3, 5], [1, 2]]]}}
    assert aoi.area(geojson=ring) == aoi.Box(1, 2, 3, 5)
    for bad in ({}, {"point": (1, 2), "bbox": (0, 0, 1, 1)}, {"bbox": (0, 5, 1, 1)}):
        with pytest.raises(ValueError):
            aoi.area(**bad)
    assert aoi.padded(aoi.Box(0, 0, 0, 2), 1.0) == aoi.Box(-0.5, 0, 0.5, 2)


def test_longitudes_wrap(spark):
    df = spark.createDataFrame([(float(x), 0.0) for x in range(0, 360, 10)], "x double, y double")
    got = lambda box: sorted(r["x"] for r in aoi.crop(df, box, wrapped=True).collect())
    assert got(aoi.Box(-20, -1, 10, 1)) == [0.0, 10.0, 340.0, 350.0] and got(aoi.Box(170, -1, -170, 1)) == [170.0, 180.0, 190.0]


def cells(n):
    return [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 40.0 + y, -105.0, float(i + y)) for i in range(n) for y in (0, 1)]


def test_read_write_and_prune(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame(cells(10), "date date, lat double, lon double, temp double").write.parquet(path)
    cube = cubes.load_cube(spark, path, ["temp"], box=aoi.Box(-106, 39.5, -104, 40.5), start="2024-01-03", end="2024-01-05", require_values=True)
    assert sorted(r["temp"] for r in cube.df.collect()) == [2.0, 3.0, 4.0] and not cube.attrs["is_synthetic"]
    plan = cubes.read_cells(spark, path, ["temp"], box=aoi.Box(-106, 39.5, -104, 40.5), start="2024-01-03")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(lon,-106.0)" in plan
    with pytest.raises(ValueError):
        cubes.load_cube(spark, path, ["temp"], start="2030-01-01", require_values=True)
    cubes.write_cube(cube, str(tmp_path / "tiles"), days=2, cells=1.0)
    assert spark.read.parquet(str(tmp_path / "tiles")).count() == 3
    monthly = cubes.load_cube(spark, path, ["temp"], freq="month")
    assert sorted(r["temp"] for r in monthly.df.collect()) == [4.5, 5.5]


def test_scenes(spark):
    df = spark.createDataFrame([(1, "r", 5.0), (1, "n", 6.0), (2, "r", 7.0), (3, "r", float("nan")), (3, "n", None)], "time int, band string, value double")
    assert {r["time"] for r in cubes.complete_scenes(df, ["r", "n"]).collect()} == {1, 3}
    assert {r["time"] for r in cubes.drop_bad_times(df).collect()} == {1, 2}
    assert cubes.temperature_variable("gridmet") == "tmmx" and cubes.temperature_variable("prism", "min") == "tmin"


def test_batches_are_not_computed_twice(spark, tmp_path):
    calls = []
    make = lambda k: lambda: calls.append(k) or spark.range(k)
    for _ in range(2):
        out = cubes.write_batches(spark, {"a": make(2), "b": make(3)}, str(tmp_path / "b"))
    assert calls == [2, 3] and out.count() == 5


def test_streamed_windows_equal_batch(spark, tmp_path):
    schema = "time timestamp, y long, x long, value double"
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=6 * i), i % 2, 0, float(i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cells = streams.read_cells(spark, str(tmp_path / "in"), schema)
    streams.start(streams.windowed_stats(cells, late="30 days"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    q = streams.windowed_stats(cells, late="30 days").writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["start"], r["y"]): (r["n"], r["mean"]) for r in spark.table("stats").collect()}
    batch = spark.createDataFrame(rows, schema).groupBy(F.window("time", "1 day").alias("w"), "y").agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    assert got == {(r["w"]["start"], r["y"]): (r["n"], r["m"]) for r in batch.collect()}


def test_runs_survive_batches(spark, tmp_path):
    schema = "time timestamp, y long, x long, value double"
    values = [5, 50, 60, 5, 70, 5, 5, 80]
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 0, 0, float(v)) for i, v in enumerate(values)]
    for k in range(4):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.track_runs(streams.read_cells(spark, str(tmp_path / "in"), schema), 40.0, max_gap_days=1, late="90 days").writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = [(r["duration"], r["peak"]) for r in spark.table("runs").where("not open").collect()]
    still = spark.table("runs").where("open").collect()
    assert closed == [(3, 70.0)] and any(r["duration"] == 1 and r["peak"] == 80.0 for r in still)


def test_runs_take_late_cells(spark, tmp_path):
    schema = "time timestamp, y long, x long, value double"
    day = lambda n, v: (dt.datetime(2024, 1, 1) + dt.timedelta(days=n), 0, 0, float(v))
    for batch in ([day(10, 50), day(12, 60)], [day(11, 70)], [day(9, 45), day(3, 41)], [day(13, 42)], [day(30, 99)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.track_runs(streams.read_cells(spark, str(tmp_path / "in"), schema), 40.0, max_gap_days=1, late="90 days").writeStream.format("memory").queryName("late_runs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {(r["start"].day, r["end"].day, r["duration"], r["peak"]) for r in spark.table("late_runs").where("not open").collect()}
    assert closed == {(4, 4, 1, 41.0), (10, 14, 5, 70.0)}


def test_known_sources(spark, tmp_path):
    rows = [(dt.date(2024, 1, d), 40 + i / 24, -100 + j / 24, 273.15 + d, float(d)) for d in range(1, 4) for i in range(3) for j in range(3)]
    path = str(tmp_path / "cells")
    spark.createDataFrame(rows, "time date, lat double, lon double, tmmx double, vs double").write.parquet(path)
    day = catalogs.load_source(spark, "gridmet", path, ["tmmx", "vs"], freq="day", point=(-100 + 1 / 24, 40 + 1 / 24))
    assert day.attrs["units"] == {"tmmx": "degC", "vs": "m/s"} and {round(r["tmmx"], 6) for r in day.df.collect()} == {1.0, 2.0, 3.0}
    month = catalogs.load_source(spark, "gridmet", path, bbox=(-101, 39, -99, 41))
    assert month.variables == ("tmmx",) and {round(r["tmmx"], 6) for r in month.df.collect()} == {2.0} and month.df.count() == 9
    with pytest.raises(ValueError):
        catalogs.load_source(spark, "gridmet", path, ["ppt"], point=(-100, 40))
    assert not catalogs.is_large(365, bbox=(-110, 35, -100, 45)) and catalogs.is_large(36500, bbox=(-110, 35, -100, 45))
    assert catalogs.request_size(10, geojson={}, source="prism") == 25.0
    assert catalogs.center_and_edge((-1.0, 2.0, 1.0, 3.0), 100.0) == (2.5, 0.0, 2220)
    scenes = spark.createDataFrame([(dt.date(2024, 1, 1), 0.0, 0.0, b, v, c) for b, v, c in (("B04", 1.0, 10.0), ("B08", 3.0, 10.0), ("B02", 9.0, 10.0), ("B04", 5.0, 80.0))], "time date, y double, x double, band string, value double, cloud_cover double")
    cells = catalogs.scene_cells(scenes, 0.0, 0.0)
    assert cells.count() == 2 and catalogs.band_ndvi(cells, ["B04", "B08"]).first()["ndvi"] == 0.5
    assert catalogs.band_ndvi(cells.replace({"B04": "red", "B08": "nir"}), ["nir", "red"]).first()["ndvi"] == 0.5


def test_rings_from_text_and_geojson(spark, tmp_path):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 9, 5 5)))", "POINT (1 2)", None]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, wkt string").select("i", catalogs.wkt_ring(F.col("wkt")).alias("r")).orderBy("i").collect()
    assert [len(r["r"]) if r["r"] else None for r in out] == [5, 5, None, None] and out[1]["r"][0]["x"] == 5.0
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [{"type": "Feature", "properties": {"id": "a", "date": "2024-01-02"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {"id": "b", "date": "2024-01-03"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], square]}}, {"type": "Feature", "properties": {"id": "c", "date": None}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "fires.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    rings = {r["event_id"]: r for r in catalogs.read_rings(spark, str(tmp_path / "fires.geojson")).withColumn("area", geometry.area(F.col("ring"))).collect()}
    assert rings["a"]["area"] == rings["b"]["area"] == 4.0 and rings["c"]["ring"] is None and str(rings["b"]["time"]) == "2024-01-03"
    spark.createDataFrame([("x", dt.date(2024, 1, 1), texts[0], 7)], "id string, date date, wkt string, size int").write.parquet(str(tmp_path / "rings"))
    one = catalogs.read_rings(spark, str(tmp_path / "rings")).first()
    assert one["properties"] == {"size": "7"} and len(one["ring"]) == 5
