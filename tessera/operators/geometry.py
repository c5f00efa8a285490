"""Polygons as arrays of points: inside tests, areas, hulls, masks, hull metrics.

A ring is ``array<struct<x: double, y: double>>``, open or closed.  Inside tests and areas
are expressions over the array; only convex hulls and whole grids need Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..functions.stats import let
from ..plans.cube import KEYS, Cube
from .align import asof_join

RING = "array<struct<x:double,y:double>>"


def _edges(ring: Column) -> Column:
    """Each vertex with its successor, the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(ring: Column, x: Column, y: Column, eps: float = 1e-12) -> Column:
    """Whether a point is inside a ring or on its border (ray casting with an on-edge test)."""
    return _within(_edges(ring), x, y, eps)


def _within(edges: Column, x: Column, y: Column, eps: float = 1e-12) -> Column:
    """:func:`contains` where a ring's edges are at hand."""
    def on(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        return (F.abs(cross) <= eps) & x.between(F.least(ax, bx) - eps, F.greatest(ax, bx) + eps) & y.between(F.least(ay, by) - eps, F.greatest(ay, by) + eps)

    def crossed(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < ax + F.try_divide((bx - ax) * (y - ay), F.nullif(by - ay, F.lit(0.0))))

    odd = F.aggregate(edges, F.lit(0), lambda acc, e: acc + F.when(F.coalesce(crossed(e), F.lit(False)), 1).otherwise(0)) % 2 == 1
    return F.exists(edges, on) | odd


def area(ring: Column) -> Column:
    """Shoelace area."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def bounds(ring: Column) -> dict[str, Column]:
    along = {"x": F.transform(ring, lambda p: p["x"]), "y": F.transform(ring, lambda p: p["y"])}
    return {f"{n}_{c}": f(v) for c, v in along.items() for n, f in (("min", F.array_min), ("max", F.array_max))}


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid of a simple ring."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    twice = F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + cross(e))
    part = lambda c: F.aggregate(_edges(ring), F.lit(0.0), lambda acc, e: acc + (e["a"][c] + e["b"][c]) * cross(e))
    return tuple(F.try_divide(part(c), F.nullif(3 * twice, F.lit(0.0))) for c in ("x", "y"))


def resampled(ring: Column, n: int = 100) -> Column:
    """``n`` points along a ring at equal steps of its length, the first vertex first; a repeated closing vertex does not count."""
    opened = F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)

    def along(w: Column) -> Column:
        lengths = F.transform(_edges(w["r"]), lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2)))
        ends = F.aggregate(lengths, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.struct(w["r"].alias("r"), ends.alias("ends"))

    def points(w: Column) -> Column:
        total = F.element_at(w["ends"], -1)

        def at(k: Column) -> Column:
            s = k * total / n
            i = F.least(F.size(F.filter(w["ends"], lambda e: e <= s)), F.size(w["r"]))
            a, b = F.element_at(w["r"], i), F.element_at(w["r"], F.when(i == F.size(w["r"]), 1).otherwise(i + 1))
            t = F.coalesce(F.try_divide(s - F.element_at(w["ends"], i), F.nullif(F.element_at(w["ends"], i + 1) - F.element_at(w["ends"], i), F.lit(0.0))), F.lit(0.0))
            return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    return let(let(F.struct(opened.alias("r")), along), points)


def support_radii(ring: Column, angles: int = 96) -> Column:
    """Support function around the mean of the vertices: for each direction the farthest extent."""
    n = F.size(ring)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[c]) / n
    mx, my = mean("x"), mean("y")
    directions = F.array(*[F.struct(F.lit(math.cos(2 * math.pi * k / angles)).alias("c"), F.lit(math.sin(2 * math.pi * k / angles)).alias("s")) for k in range(angles)])
    return F.transform(directions, lambda d: F.array_max(F.transform(ring, lambda p: d["c"] * (p["x"] - mx) + d["s"] * (p["y"] - my))))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain, counter-clockwise; fewer than three corners for points on a line."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


def hulls(cells: DataFrame, keys: list[str], buffer: float | None = None) -> DataFrame:
    """Convex hull of the cell centres ``(keys, y, x)`` of each group.

    Groups without area (a point, a line) are left out, or with ``buffer`` get the box that
    reaches so far beyond them.
    """
    kinds = dict(cells.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = convex_hull(list(zip(pdf["x"].astype(float), pdf["y"].astype(float), strict=True)))
        if len(ring) < 3 and buffer is not None:
            (x0, x1), (y0, y1) = ((min(v) - buffer, max(v) + buffer) for v in zip(*ring, strict=True))
            ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**row, "ring": [[{"x": a, "y": b} for a, b in ring]]}) if len(ring) > 2 else pd.DataFrame({c: pd.Series([], dtype=object) for c in (*keys, "ring")})

    return cells.select(*keys, "y", "x").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", ring {RING}")


def polygon_at_times(polygons: DataFrame, times: DataFrame, interp: str = "nearest") -> DataFrame:
    """(time, ring) for each time from ``polygons(time, ring)``.

    ``nearest``: ties to the earlier; ``linear``: vertices move evenly between equal numbers of
    them; outside the covered time the first or last ring holds.
    """
    known = polygons.select("time", F.struct("time", "ring").alias("_p"))
    t = times.select("time").distinct()
    t = asof_join(asof_join(t, known.withColumnRenamed("_p", "_b"), [], "_b", "pad"), known.withColumnRenamed("_p", "_a"), [], "_a", "backfill")
    gap = lambda c: F.abs(F.datediff("time", F.col(f"{c}.time")))
    if interp == "nearest":
        ring = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b.ring")).otherwise(F.col("_a.ring"))
    elif interp == "linear":
        w = F.coalesce(F.try_divide(gap("_b").cast("double"), F.nullif(gap("_b") + gap("_a"), F.lit(0))), F.lit(0.0))
        moved = F.zip_with("_b.ring", "_a.ring", lambda p, q: F.struct((p["x"] + w * (q["x"] - p["x"])).alias("x"), (p["y"] + w * (q["y"] - p["y"])).alias("y")))
        ring = F.when(F.col("_a").isNull(), F.col("_b.ring")).when(F.col("_b").isNull(), F.col("_a.ring")).otherwise(moved)
    else:
        raise ValueError("interp is nearest or linear")
    return t.select("time", ring.alias("ring"))


def vase_mask(cube: Cube, polygons: DataFrame, interp: str = "nearest") -> Cube:
    """Cells inside the polygon of their time, its border included; a bounding box goes before the exact test."""
    rings = polygon_at_times(polygons, cube.times(), interp)
    boxed = rings.select("time", "ring", *[v.alias(f"_{k}") for k, v in bounds(F.col("ring")).items()])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    near = x.between(F.col("_min_x"), F.col("_max_x")) & y.between(F.col("_min_y"), F.col("_max_y"))
    return cube.with_df(cube.df.join(boxed, "time", "left")).with_values(mask=F.coalesce(F.when(near, contains(F.col("ring"), x, y)).otherwise(False), F.lit(False)))


def vase_extract(cube: Cube, polygons: DataFrame, interp: str = "nearest") -> Cube:
    """Values inside the polygon, missing outside."""
    m = vase_mask(cube, polygons, interp).df.select(*KEYS, "mask")
    v = cube.variable
    joined = cube.with_df(cube.df.join(m, [*KEYS]))
    return joined.with_values(**{v: F.when(F.col("mask"), F.col(v))})


def vase_points(cube: Cube, polygons: DataFrame, interp: str = "nearest") -> DataFrame:
    """Cells with a value inside the polygon."""
    inside = vase_extract(cube, polygons, interp)
    return inside.df.where(F.col(inside.variable).isNotNull()).select(*KEYS, inside.variable)


def latest_ring(cells: DataFrame, perimeters: DataFrame, keys: list[str]) -> DataFrame:
    """``cells(keys, time, ...)`` with the last ring of ``perimeters(keys, time, ring)`` up to their time."""
    days = asof_join(cells.select(*keys, "time").distinct(), perimeters.select(*keys, "time", "ring"), keys, "ring")
    return cells.join(days, [*keys, "time"], "left").select(*cells.columns, "ring")


def sample_inside_outside(cells: DataFrame, perimeters: DataFrame, keys: list[str], half: float) -> DataFrame:
    """Whether each cell lies wholly inside the latest perimeter; where no cell of an event and day does, its centre decides."""
    # A ring's edges and bounds are worked out once, not for every cell that meets it.
    whole_ring = F.struct(_edges(F.col("ring")).alias("edges"), *[v.alias(k) for k, v in bounds(F.col("ring")).items()])
    known = cut(perimeters.select(*keys, "time", whole_ring.alias("ring")))
    c = latest_ring(cells, known, keys)
    x, y, ring = F.col("x").cast("double"), F.col("y").cast("double"), F.col("ring")
    near = x.between(ring["min_x"], ring["max_x"]) & y.between(ring["min_y"], ring["max_y"])
    inner = (x - half >= ring["min_x"]) & (x + half <= ring["max_x"]) & (y - half >= ring["min_y"]) & (y + half <= ring["max_y"])
    corners = [_within(ring["edges"], x + i * half, y + j * half) for i in (-1, 1) for j in (-1, 1)]
    test = lambda first, then: F.when(F.coalesce(first, F.lit(False)), then).otherwise(F.lit(False))
    marked = c.withColumns({"_whole": test(inner, corners[0] & corners[1] & corners[2] & corners[3]), "_center": test(near, _within(ring["edges"], x, y))})
    some = F.bool_or("_whole").over(Window.partitionBy(*keys, "time"))
    return marked.withColumn("inside", F.when(some, F.col("_whole")).otherwise(F.col("_center"))).drop("_whole", "_center", "ring")


def climate_samples(cells: DataFrame, perimeters: DataFrame, keys: list[str], half: float, value: str) -> DataFrame:
    """(keys, time, mean and number of values inside and outside) between each event's first and last ring.

    ``cells(keys, time, y, x, value)``; days outside the span are left out, and an event
    without any gives no row.
    """
    span = perimeters.groupBy(*keys).agg(F.min("time").alias("_t0"), F.max("time").alias("_t1"))
    within = cells.join(span, keys).where(F.col("time").between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")
    marked = sample_inside_outside(within, perimeters, keys, half)
    pick = lambda inside: F.when(F.col("inside") == inside, F.col(value))
    return marked.groupBy(*keys, "time").agg(F.avg(pick(True)).alias("inside_mean"), F.count(pick(True)).alias("n_inside"), F.avg(pick(False)).alias("outside_mean"), F.count(pick(False)).alias("n_outside"))


def _inside_grid(ring: np.ndarray, y: np.ndarray, x: np.ndarray, half: float) -> np.ndarray:
    """:func:`sample_inside_outside` of one ring (a row for each vertex, x and y) and the cells of a grid, all edges and cells at once."""
    if not len(ring):
        return np.zeros(len(x), bool)
    a, b = ring[:, None], np.roll(ring, -1, axis=0)[:, None]
    (ax, ay), (bx, by) = (a[..., 0], a[..., 1]), (b[..., 0], b[..., 1])
    (x0, y0), (x1, y1), eps = ring.min(axis=0), ring.max(axis=0), 1e-12

    def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        on = (np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) <= eps) & (x >= np.minimum(ax, bx) - eps) & (x <= np.maximum(ax, bx) + eps) & (y >= np.minimum(ay, by) - eps) & (y <= np.maximum(ay, by) + eps)
        crossed = ((ay > y) != (by > y)) & (x < ax + (bx - ax) * (y - ay) / np.where(by == ay, np.nan, by - ay))
        return on.any(axis=0) | (crossed.sum(axis=0) % 2 == 1)

    out = (x - half >= x0) & (x + half <= x1) & (y - half >= y0) & (y + half <= y1)
    inner = np.flatnonzero(out)
    for i in (-1, 1):
        for j in (-1, 1):
            out[inner] &= within(x[inner] + i * half, y[inner] + j * half)
    if not out.any():
        near = np.flatnonzero((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
        out[near] = within(x[near], y[near])
    return out


def climate_samples_on_grid(days: DataFrame, perimeters: DataFrame, keys: list[str], half: float, grid: DataFrame, value: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """:func:`climate_samples` where all days of ``days(keys, time)`` have the cells of one ``grid(y, x)``.

    The grid travels to the days, so that no cell becomes a row.  ``value(days, y, x)`` gives
    the values of a batch, a row for each day: it gets the keys as columns and the cells'
    places as rows; NaN is missing.  A batch's equal rings are tested once.
    """
    span = perimeters.groupBy(*keys).agg(F.min("time").alias("_t0"), F.max("time").alias("_t1"))
    within = days.select(*keys, "time").join(span, keys).where(F.col("time").between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")
    rings = asof_join(within, perimeters.select(*keys, "time", F.coalesce(F.transform("ring", lambda p: F.array(p["x"], p["y"])), F.array()).alias("ring")), keys, "ring")
    cells = grid.select(*[F.col(c).cast("double").alias(c) for c in ("y", "x")]).toArrow()
    places = grid.sparkSession.sparkContext.broadcast((cells["y"].to_numpy(), cells["x"].to_numpy()))
    means = ["inside_mean", "n_inside", "outside_mean", "n_outside"]
    schema = rings.select(*keys, "time").schema
    for m in means:
        schema = schema.add(m, "long" if m.startswith("n_") else "double")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = places.value
        for batch in batches:
            corners = batch["ring"]
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(corners), 0).to_numpy()))
            xy = corners.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(xy[i:j].tobytes(), len(known)) for i, j in zip(ends[:-1], ends[1:], strict=True)], np.int64)
            masks = np.array([_inside_grid(np.frombuffer(r).reshape(-1, 2), y, x, half) for r in known]).reshape(len(known), len(x))
            v = np.broadcast_to(value({k: batch[k].to_numpy(zero_copy_only=False)[:, None] for k in keys}, y[None], x[None]), (len(which), len(x)))
            there = ~np.isnan(v)
            v, inside = np.where(there, v, 0.0), masks[which]
            n_in, n_all = (inside & there).sum(axis=1), there.sum(axis=1)
            columns = [batch[k] for k in (*keys, "time")]
            for pick, n in ((inside, n_in), (~inside, n_all - n_in)):
                mean = np.divide(np.where(pick, v, 0.0).sum(axis=1), n, out=np.zeros(len(n)), where=n > 0)
                columns += [pa.array(mean, mask=n == 0), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "time", *means])

    return rings.select(*keys, "time", "ring").mapInArrow(sample, schema)


def clean_daily_rings(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Daily rings in order, without empty ones and without repeats of the day before."""
    w = Window.partitionBy(*keys).orderBy("time")
    full = daily.where(F.col("ring").isNotNull() & (F.size("ring") > 2))
    return full.withColumn("_prev", F.lag("ring").over(w)).where(~F.col("ring").eqNullSafe(F.col("_prev"))).drop("_prev")


def hull_metrics(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Per event: days, area at the peak and at the end, volume (trapezoids of area over days), mean and largest radius."""
    r = daily.withColumns({"area": area(F.col("ring")), "radii": support_radii(F.col("ring"))})
    w = Window.partitionBy(*keys).orderBy("time")
    step = F.datediff("time", F.lag("time").over(w))
    r = r.withColumn("slab", F.coalesce((F.col("area") + F.lag("area").over(w)) / 2 * step, F.lit(0.0)))
    radius = F.aggregate("radii", F.lit(0.0), lambda acc, x: acc + x) / F.size("radii")
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_days"), F.max("area").alias("peak_area"), F.max_by("area", "time").alias("final_area"), F.sum("slab").alias("volume"), F.avg(radius).alias("mean_radius"), F.max(F.array_max("radii")).alias("max_radius"))


def derivative(series: DataFrame, keys: list[str], order: str, value: str, times: int = 1) -> DataFrame:
    """Central differences, one-sided at the ends, as ``d_value``; taken twice as ``d2_value``, with its size ``radius``."""
    w = Window.partitionBy(*keys).orderBy(order)

    def once(v: str) -> Column:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        return F.when(before.isNull(), after - F.col(v)).when(after.isNull(), F.col(v) - before).otherwise((after - before) / 2)

    out = series.withColumn(f"d_{value}", once(value))
    if times == 1:
        return out
    return out.withColumn(f"d2_{value}", once(f"d_{value}")).withColumn("radius", F.abs(f"d2_{value}"))


def time_hull(daily: DataFrame, keys: list[str], n_ring: int = 100, angles: int = 96) -> DataFrame:
    """Layers of the hull of each event's daily rings: (keys, layer, time, z, area, radii in kilometres).

    Rings in metres are resampled at equal steps and centred by the mean of the samples;
    radii are those of the support function.  Layers count from 1 by time.
    """
    rings = daily.where(F.col("ring").isNotNull() & (F.size("ring") > 2)).withColumn("_s", resampled(F.col("ring"), n_ring))
    layer = F.row_number().over(Window.partitionBy(*keys).orderBy("time"))
    return rings.select(*keys, layer.alias("layer"), "time", layer.cast("double").alias("z"), area(F.col("ring")).alias("area_m2"), F.transform(support_radii(F.col("_s"), angles), lambda r: r / 1000.0).alias("radii"))


def hull_vertices(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices of a time hull: (keys, layer, corner, x, y, z, t_norm), corners from 0."""
    w = Window.partitionBy(*keys)
    t = F.try_divide(F.col("z") - F.min("z").over(w), F.greatest(F.max("z").over(w) - F.min("z").over(w), F.lit(1e-9)))
    v = layers.withColumns({"t_norm": t, "_n": F.size("radii")}).select("*", F.posexplode("radii").alias("corner", "_r"))
    turn = 2 * math.pi * F.col("corner") / F.col("_n")
    return v.select(*keys, "layer", "time", "corner", (F.col("_r") * F.cos(turn)).alias("x"), (F.col("_r") * F.sin(turn)).alias("y"), "z", "t_norm")


def hull_summary(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Days, scale, volume (trapezoids) and surface (two triangles for each corner and step) of each time hull; none under two layers."""
    w = Window.partitionBy(*keys).orderBy("layer")
    both = layers.withColumns({"_r": F.lag("radii").over(w), "_z": F.lag("z").over(w), "_a": F.lag("area_m2").over(w)})
    n = F.size("radii")

    def triangle(p: list[Column], q: list[Column], r: list[Column]) -> Column:
        u, v = [b - a for a, b in zip(p, q, strict=True)], [b - a for a, b in zip(p, r, strict=True)]
        cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        return F.sqrt(sum((c * c for c in cross), F.lit(0.0))) / 2

    def strip(j: Column) -> Column:
        k = (j + 1) % n
        point = lambda radii, i, z: [F.element_at(radii, i + 1) * F.cos(2 * math.pi * i / n), F.element_at(radii, i + 1) * F.sin(2 * math.pi * i / n), F.col(z)]
        a, b, c, d = point("_r", j, "_z"), point("_r", k, "_z"), point("radii", k, "z"), point("radii", j, "z")
        return triangle(a, b, c) + triangle(a, c, d)

    surface = F.when(F.col("_r").isNotNull(), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, j: acc + strip(j)))
    slab = (F.col("area_m2") + F.col("_a")) / 2 * (F.col("z") - F.col("_z")) / 1e6
    out = both.select(*keys, surface.alias("_surface"), slab.alias("_slab"), F.array_max("radii").alias("_top"))
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.max("_top").alias("scale_km"), F.sum("_slab").alias("volume_km2_days"), F.sum("_surface").alias("surface_km_day")).where(F.col("days") >= 2)


def attach_environment(layers: DataFrame, series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Layers with the ``value`` of ``series(time, value)`` at their date: the last before it, or at the beginning the first after."""
    dates = layers.select("time").distinct()
    back = asof_join(dates, series.select("time", F.col(value).alias("_b")), [], "_b", "pad")
    both = asof_join(back, series.select("time", F.col(value).alias("_f")), [], "_f", "backfill")
    return layers.join(both.select("time", F.coalesce("_b", "_f").alias(value)), "time", "left").select(*layers.columns, value)


def event_daily(daily: DataFrame, keys: list[str], steps: int = 64) -> DataFrame:
    """(keys, first and last day, days, centroid of the union of the rings) of each event, from its clean daily rings.

    The union is taken on a raster of ``steps`` by ``steps`` points over its bounds, so the
    centroid is as exact as a step.
    """
    clean_rings = clean_daily_rings(daily, keys)
    boxed = clean_rings.select(*keys, "time", _edges(F.col("ring")).alias("edges"), *[v.alias(k) for k, v in bounds(F.col("ring")).items()])
    events = boxed.groupBy(*keys).agg(F.min("time").alias("t0"), F.max("time").alias("t1"), F.count(F.lit(1)).alias("n_days"), F.min("min_x").alias("x0"), F.max("max_x").alias("x1"), F.min("min_y").alias("y0"), F.max("max_y").alias("y1"), F.collect_list("edges").alias("rings"))
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    points = events.withColumn("_i", step).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    place = lambda a, b, k: F.col(a) + (F.col(k) + 0.5) * (F.col(b) - F.col(a)) / steps
    points = points.withColumns({"px": place("x0", "x1", "_i"), "py": place("y0", "y1", "_j")})
    inside = F.exists("rings", lambda edges: _within(edges, F.col("px"), F.col("py")))
    return points.where(inside).groupBy(*keys, "t0", "t1", "n_days").agg(F.avg("px").alias("centroid_x"), F.avg("py").alias("centroid_y"))


def cells_or_nearest(cells: DataFrame, rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, nearest) for each of ``rings(keys, ring)``: the cell centres inside, or, where there is none, the one nearest the centroid.

    ``cells(y, x)`` are one row per pixel; only the rings' bounding boxes are searched first.
    """
    cx, cy = centroid(F.col("ring"))
    boxed = rings.select(*keys, "ring", cx.alias("_cx"), cy.alias("_cy"), *[v.alias(f"_{k}") for k, v in bounds(F.col("ring")).items()])
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    near = x.between(F.col("_min_x"), F.col("_max_x")) & y.between(F.col("_min_y"), F.col("_max_y"))
    inside = cells.join(boxed, near).where(contains(F.col("ring"), x, y)).select(*keys, "y", "x", F.lit(False).alias("nearest"))
    bare = boxed.join(inside.select(*keys).distinct(), keys, "left_anti")
    gap = F.pow(x - F.col("_cx"), 2) + F.pow(y - F.col("_cy"), 2)
    closest = cells.crossJoin(bare).groupBy(*keys).agg(F.min_by(F.struct("y", "x"), F.struct(F.round(gap, 9), F.col("y"), F.col("x"))).alias("_c"))
    return inside.unionByName(closest.select(*keys, "_c.y", "_c.x", F.lit(True).alias("nearest")))


def pick_event(daily: DataFrame, min_days: int) -> DataFrame:
    """The first event, in order of appearance, with enough distinct days."""
    return daily.groupBy("event_id").agg(F.countDistinct("time").alias("n_days"), F.min("time").alias("first_seen")).where(F.col("n_days") >= min_days).orderBy("first_seen", "event_id").limit(1)
