"""Areas of interest as pushdown predicates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half the side of the box around a point, in degrees.
POINT_BUFFER = 0.05


@dataclass(frozen=True)
class Box:
    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    def __post_init__(self) -> None:
        if self.min_lat > self.max_lat:
            raise ValueError("the box's latitudes are in the wrong order")

    @property
    def crosses_dateline(self) -> bool:
        return self.min_lon > self.max_lon


def _points(geometry: Any) -> list[tuple[float, float]]:
    """All positions of a GeoJSON object of any kind."""
    if isinstance(geometry, Mapping):
        kind = geometry.get("type")
        if kind == "FeatureCollection":
            return [p for f in geometry["features"] for p in _points(f)]
        if kind == "Feature":
            return _points(geometry["geometry"])
        if kind == "GeometryCollection":
            return [p for g in geometry["geometries"] for p in _points(g)]
        return _points(geometry["coordinates"])
    if geometry and isinstance(geometry[0], (int, float)):
        return [(float(geometry[0]), float(geometry[1]))]
    return [p for part in geometry for p in _points(part)]


def area(point: tuple[float, float] | None = None, bbox: tuple[float, float, float, float] | None = None, geojson: Mapping | None = None) -> Box:
    """Exactly one of a point (lon, lat), a box (min lon, min lat, max lon, max lat) and a GeoJSON object."""
    given = [v for v in (point, bbox, geojson) if v is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of point, bbox and geojson")
    if point is not None:
        lon, lat = point
        return Box(lon - POINT_BUFFER, lat - POINT_BUFFER, lon + POINT_BUFFER, lat + POINT_BUFFER)
    if bbox is not None:
        return Box(*map(float, bbox))
    lons, lats = zip(*_points(geojson), strict=True)
    return Box(min(lons), min(lats), max(lons), max(lats))


def inside(box: Box, lon: str = "x", lat: str = "y", wrapped: bool = False) -> Column:
    """Cells in the closed box; ``wrapped``: longitudes of the data run from 0 to 360.

    A box across the dateline becomes two ranges.
    """
    x, y = F.col(lon), F.col(lat)
    lo, hi = (box.min_lon % 360, box.max_lon % 360) if wrapped else (box.min_lon, box.max_lon)
    in_x = x.between(lo, hi) if lo <= hi else (x >= lo) | (x <= hi)
    return in_x & y.between(box.min_lat, box.max_lat)


def padded(box: Box, step: float) -> Box:
    """A box widened to at least one grid step, so that a small area still meets a cell."""
    dx, dy = max(0.0, step - (box.max_lon - box.min_lon)) / 2, max(0.0, step - (box.max_lat - box.min_lat)) / 2
    return Box(box.min_lon - dx, box.min_lat - dy, box.max_lon + dx, box.max_lat + dy)


def crop(df: DataFrame, box: Box, **names: Any) -> DataFrame:
    return df.where(inside(box, **names))
