"""Known sources read from files: their variables, units and grids, and rings of events.

Nothing here goes over a network: a source is a Parquet table of cells, or files of rings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import area as ring_area
from ..operators.reduce import kelvin_to_celsius, ndvi
from ..plans.cube import Cube
from .aoi import Box
from .aoi import area as area_of_interest
from .cubes import cloud_filter, load_cube

# Units of the sources' variables, and the sides of their cells in degrees.
UNITS = {
    "gridmet": {"tmmx": "K", "tmmn": "K", "pr": "mm", "vpd": "kPa", "vs": "m/s", "rmax": "%", "rmin": "%", "srad": "W/m^2", "sph": "kg/kg", "pet": "mm", "eto": "mm", "erc": "1", "bi": "1", "fm100": "%", "fm1000": "%"},
    "prism": {"ppt": "mm", "tmean": "degC", "tmin": "degC", "tmax": "degC", "tdmean": "degC", "vpdmin": "hPa", "vpdmax": "hPa"},
}
STEP = {"gridmet": 1 / 24, "prism": 1 / 24}
DEFAULT = {"gridmet": ("tmmx", "month"), "prism": ("ppt", "month")}
#: Area in square degrees times days beyond which a request counts as large; a finer source counts for more.
LARGE, FINER = 2.5e6, {"prism": 1.25}
METRES_PER_DEGREE = 111_000


def load_source(spark: SparkSession, source: str, path: str, variables: list[str] | None = None, freq: str | None = None, celsius: bool = True, point: tuple[float, float] | None = None, bbox: tuple[float, float, float, float] | None = None, geojson: Mapping | None = None, **options) -> Cube:
    """A cube of a known source from a table of its cells.

    The area is widened to a cell of the source's grid.  ``freq`` is the source's usual one
    unless given (``day`` takes the cells as they are).  Temperatures in kelvin become
    degrees Celsius.  Units go along in ``attrs``.
    """
    if source not in UNITS:
        raise ValueError(f"source is one of {sorted(UNITS)}")
    wanted = variables or [DEFAULT[source][0]]
    if unknown := sorted(set(wanted) - set(UNITS[source])):
        raise ValueError(f"{source} has no {unknown}")
    box = area_of_interest(point, bbox, geojson)
    by = freq or DEFAULT[source][1]
    cube = load_cube(spark, path, wanted, freq=None if by == "day" else by, box=box, grid_step=STEP[source], **options)
    units = {v: UNITS[source][v] for v in wanted}
    if celsius and "K" in units.values():
        cube = cube.with_values(**{v: kelvin_to_celsius(F.col(v)) if units[v] == "K" else F.col(v) for v in wanted})
        units = {v: "degC" if u == "K" else u for v, u in units.items()}
    return Cube(cube.df, cube.variables, cube.descending, cube.attrs | {"source": source, "units": units, "freq": by})


def request_size(days: int, bbox: tuple[float, float, float, float] | None = None, geojson: Mapping | None = None, source: str = "gridmet") -> float:
    """A rough size of a request: square degrees, at least one (two for a shape), times days."""
    if bbox is not None:
        extent = max((bbox[2] - bbox[0]) * (bbox[3] - bbox[1]), 1.0)
    else:
        extent = 1.0 if geojson is None else 2.0
    return float(extent * FINER.get(source, 1.0) * max(days, 1))


def is_large(days: int, **request) -> bool:
    """Whether a request would be cut into tiles; Spark reads either kind lazily."""
    return request_size(days, **request) > LARGE


def center_and_edge(bbox: tuple[float, float, float, float], resolution: float, edge: int = 0) -> tuple[float, float, int]:
    """(lat, lon, edge in cells) of the square around a box, at least ``edge`` cells wide."""
    span = max(abs(bbox[2] - bbox[0]), abs(bbox[3] - bbox[1]))
    return (bbox[1] + bbox[3]) / 2, (bbox[0] + bbox[2]) / 2, max(edge, int(span * METRES_PER_DEGREE / resolution))


def square_around(lat: float, lon: float, edge: int, resolution: float) -> Box:
    """The box of ``edge`` cells of ``resolution`` metres around a point."""
    half = edge * resolution / METRES_PER_DEGREE / 2
    return Box(lon - half, lat - half, lon + half, lat + half)


def scene_cells(cells: DataFrame, lat: float, lon: float, edge: int = 1028, resolution: int = 10, cloud_below: float = 40, bands: tuple[str, ...] = ("B04", "B08")) -> DataFrame:
    """Cells ``(time, y, x, band, value, cloud_cover)`` of the wanted bands around a point, from scenes with less cloud."""
    box = square_around(lat, lon, edge, resolution)
    near = F.col("y").between(box.min_lat, box.max_lat) & F.col("x").between(box.min_lon, box.max_lon)
    return cloud_filter(cells.where(near & F.col("band").isin(list(bands))), cloud_below)


def band_ndvi(cells: DataFrame, bands: list[str], red: str = "red", nir: str = "nir") -> DataFrame:
    """(time, y, x, ndvi) from cells with a band: by the names of the two bands or, where one is missing, by their places."""
    if red not in bands or nir not in bands:
        red, nir = bands[0], bands[1]
    pick = lambda b: F.max(F.when(F.col("band") == b, F.col("value")))
    wide = cells.where(F.col("band").isin(red, nir)).groupBy("time", "y", "x").agg(pick(red).alias("_r"), pick(nir).alias("_n"))
    return wide.select("time", "y", "x", ndvi(F.col("_n"), F.col("_r")).alias("ndvi"))


def _largest(rings: Column) -> Column:
    """The ring with the largest area, the first of equals."""
    return F.element_at(F.array_sort(F.transform(rings, lambda r, i: F.struct((-ring_area(r)).alias("a"), i.alias("i"), r.alias("r")))), 1)["r"]


def wkt_ring(wkt: Column) -> Column:
    """The outer ring of a polygon in well-known text, of several polygons that of the largest; null for other text."""
    outer = F.regexp_extract_all(wkt, F.lit(r"\(\(([^()]*)\)"), F.lit(1))
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    rings = F.transform(outer, lambda t: F.transform(F.split(t, ","), point))
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON\s*(Z\s*)?\(") & (F.size(outer) > 0), _largest(rings))


def geojson_ring(geometry: Column) -> Column:
    """The outer ring of a GeoJSON polygon, of a multipolygon that of the largest; null for other geometries."""
    kind, body = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    points = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.from_json(body, "array<array<array<double>>>")
    many = F.from_json(body, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", points(one[0])).when(kind == "MultiPolygon", _largest(F.transform(many, lambda polygon: points(polygon[0]))))


def read_rings(spark: SparkSession, path: str, id_column: str = "id", date_column: str = "date") -> DataFrame:
    """(event_id, time, ring, properties) from GeoJSON collections, or from Parquet with a column ``wkt`` or ``ring``."""
    if path.rstrip("/").endswith(("json", "geojson")):
        files = spark.read.option("multiLine", True).schema("features array<struct<properties: map<string, string>, geometry: string>>").json(path)
        f = files.select(F.explode("features").alias("f")).select("f.*")
        return f.select(F.element_at("properties", id_column).alias("event_id"), F.to_date(F.element_at("properties", date_column)).alias("time"), geojson_ring(F.col("geometry")).alias("ring"), "properties")
    df = spark.read.parquet(path)
    ring = F.col("ring") if "ring" in df.columns else wkt_ring(F.col("wkt"))
    rest = [c for c in df.columns if c not in (id_column, date_column, "ring", "wkt")]
    properties = F.create_map(*[e for c in rest for e in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.col(id_column).cast("string").alias("event_id"), F.to_date(date_column).alias("time"), ring.alias("ring"), properties.alias("properties"))
