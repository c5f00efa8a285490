"""Reductions, anomalies and other per-pixel or per-time statistics of cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import compare, quantile, steps
from ..plans.cube import KEYS, PIXEL, POSITIONS, Cube, dense
from ..plans.pipe import verb
from .align import nearest

DIMS = {"time": ("time", "t_idx"), "y": ("y", "y_idx"), "x": ("x", "x_idx")}


def _kept(dim: str | list[str] | tuple[str, ...]) -> list[str]:
    gone = (dim,) if isinstance(dim, str) else tuple(dim)
    if "space" in gone:
        gone = (*(d for d in gone if d != "space"), "y", "x")
    if unknown := set(gone) - set(DIMS):
        raise ValueError(f"no dimension {sorted(unknown)}")
    return [c for d, cols in DIMS.items() if d not in gone for c in cols]


def reduce_cube(cube: Cube, aggregate, dim: str | list[str] = "time", skipna: bool = True, keep_dim: bool = False) -> DataFrame:
    """``aggregate`` of each variable over dimensions; with ``skipna=False`` a missing value makes the result missing.

    ``keep_dim`` (one dimension only) leaves the dimension in as a single null coordinate.
    """
    def one(v: str) -> Column:
        out = aggregate(F.col(v))
        return (out if skipna else F.when(F.count(v) == F.count(F.lit(1)), out)).alias(v)

    if keep_dim and not isinstance(dim, str):
        raise ValueError("keep_dim needs a single dimension")
    out = cube.df.groupBy(*_kept(dim)).agg(*[one(v) for v in cube.variables])
    if keep_dim:
        kind = dict(cube.df.dtypes)[dim]
        out = out.withColumns({dim: F.lit(None).cast(kind), DIMS[dim][1]: F.lit(0)})
    return out


@verb
def mean(cube: Cube, dim: str | list[str] = "time", skipna: bool = True, keep_dim: bool = False) -> DataFrame:
    return reduce_cube(cube, F.avg, dim, skipna, keep_dim)


@verb
def variance(cube: Cube, dim: str | list[str] = "time", skipna: bool = True, keep_dim: bool = False, ddof: int = 0) -> DataFrame:
    return reduce_cube(cube, F.var_samp if ddof else F.var_pop, dim, skipna, keep_dim)


@verb
def mean_and_variance(cube: Cube, dim: str | list[str] = "time") -> DataFrame:
    """Mean and sample variance of the values, in one pass."""
    both = cube.with_values(mean=F.col(cube.variable), variance=F.col(cube.variable))
    keep = [c for d, (c, _) in DIMS.items() if d not in (dim if isinstance(dim, list) else [*PIXEL] if dim == "space" else [dim])]
    return both.df.groupBy(*keep).agg(F.avg("mean").alias("mean"), F.var_samp("variance").alias("variance"))


@verb
def median(cube: Cube, dim: str | list[str] = "time", skipna: bool = True) -> DataFrame:
    return reduce_cube(cube, lambda v: quantile(v, 0.5), dim, skipna)


def _over(cube: Cube, dim: str) -> Window:
    return Window.partitionBy(*[c for d, (c, _) in DIMS.items() if d != dim and not (dim == "space" and d in PIXEL)])


@verb
def anomaly(cube: Cube, dim: str = "time") -> Cube:
    """Value less its mean over ``dim``."""
    w = _over(cube, dim)
    return cube.with_values(**{v: F.col(v) - F.avg(v).over(w) for v in cube.variables})


@verb
def zscore(cube: Cube, dim: str = "time", std_eps: float = 1e-4) -> Cube:
    """Anomaly in population standard deviations; missing where these are at most ``std_eps``."""
    w = _over(cube, dim)
    sd = lambda v: F.stddev_pop(v).over(w)
    return cube.with_values(**{f"{v}_zscore": F.when(sd(v) > std_eps, (F.col(v) - F.avg(v).over(w)) / sd(v)) for v in cube.variables})


@verb
def temporal_anomaly(cube: Cube, start: str, end: str) -> Cube:
    """Value less its mean over the baseline from ``start`` to ``end``, both included."""
    w = cube.over_pixel()
    inside = F.col("time").between(F.lit(start).cast(dict(cube.df.dtypes)["time"]), F.lit(end).cast(dict(cube.df.dtypes)["time"]))
    return cube.with_values(**{v: F.col(v) - F.avg(F.when(inside, F.col(v))).over(w) for v in cube.variables})


def anomaly_against(cube: Cube, baseline: Cube) -> Cube:
    """Value less the mean of another cube of the same pixels; a pixel missing there gives null."""
    base = mean(baseline, "time").select(*PIXEL, F.col(baseline.variable).alias("_base"))
    v = cube.variable
    return cube.with_df(cube.df.join(base, [*PIXEL], "left").select(*KEYS, *POSITIONS, (F.col(v) - F.col("_base")).alias(v)))


@verb
def temporal_difference(cube: Cube, lag: int | str = 1) -> Cube:
    """Value less the one ``lag`` positions before."""
    n = steps(lag, cube.times())
    w = cube.along_time()
    return cube.with_values(**{v: F.col(v) - F.lag(v, n).over(w) for v in cube.variables})


@verb
def rolling_mean(cube: Cube, window: int, min_periods: int | None = None, center: bool = False) -> Cube:
    """Mean of ``window`` positions that end at, or are centred on, each; missing below ``min_periods`` values."""
    least = window if min_periods is None else min_periods
    span = (-(window // 2), window - 1 - window // 2) if center else (1 - window, 0)
    w = cube.along_time().rowsBetween(*span)
    return cube.with_values(**{v: F.when(F.count(v).over(w) >= least, F.avg(v).over(w)) for v in cube.variables})


@verb
def running_stats(cube: Cube) -> DataFrame:
    """Count, sum, maximum, mean so far, positive steps, and whether a value is the least so far."""
    v = F.col(cube.variable)
    w = cube.along_time().rowsBetween(Window.unboundedPreceding, 0)
    return cube.df.select(
        *KEYS,
        F.count(v).over(w).alias("n_so_far"),
        F.sum(v).over(w).alias("sum_so_far"),
        F.max(v).over(w).alias("max_so_far"),
        F.avg(v).over(w).alias("mean_so_far"),
        F.count(F.when(v > 0, 1)).over(w).alias("active_so_far"),
        F.coalesce(v <= F.min(v).over(w), F.lit(False)).alias("is_min_so_far"),
    )


@verb
def month_filter(cube: Cube, months: list[int]) -> Cube:
    return cube.with_df(cube.df.where(F.month("time").isin(list(months))))


@verb
def mask_by_threshold(cube: Cube, threshold: float, direction: str = ">") -> Cube:
    return cube.with_values(mask=compare(F.col(cube.variable), threshold, direction))


@verb
def suitability(cube: Cube, low: float, high: float) -> Cube:
    """Whether the value lies between the bounds, both included."""
    return cube.with_values(suitable=F.coalesce(F.col(cube.variable).between(low, high), F.lit(False)))


@verb
def where_mask(cube: Cube, mask: Column) -> Cube:
    """Values where the mask holds, missing elsewhere."""
    return cube.with_values(**{v: F.when(mask, F.col(v)) for v in cube.variables})


@verb
def time_stride(cube: Cube, step: int) -> Cube:
    """Every ``step``-th time, the first included."""
    return cube.with_df(cube.df.where(F.col("t_idx") % step == 0))


@verb
def flatten_space(cube: Cube) -> DataFrame:
    """Cells by time and flat pixel number (row-major)."""
    nx = cube.pixels().agg((F.max("x_idx") + 1).alias("_nx"))
    return cube.df.crossJoin(F.broadcast(nx)).select("time", (F.col("y_idx").cast("long") * F.col("_nx") + F.col("x_idx")).alias("pixel"), *cube.variables)


@verb
def flatten_cube(cube: Cube) -> DataFrame:
    """Cells by sample: all keys as one struct."""
    return cube.df.select(F.struct(*KEYS).alias("sample"), *cube.variables)


def unstack_space(flat: DataFrame, nx: int) -> DataFrame:
    """Back from flat pixel numbers to row and column."""
    return flat.withColumns({"y_idx": F.floor(F.col("pixel") / nx).cast("int"), "x_idx": (F.col("pixel") % nx).cast("int")}).drop("pixel")


@verb
def coarsen_mean(cube: Cube, fy: int, fx: int) -> DataFrame:
    """Means of blocks of pixels; incomplete blocks at the far edges are left out, coordinates are averaged."""
    size = cube.pixels().agg((F.max("y_idx") + 1).alias("_ny"), (F.max("x_idx") + 1).alias("_nx"))
    inside = (F.col("y_idx") < F.col("_ny") - F.col("_ny") % fy) & (F.col("x_idx") < F.col("_nx") - F.col("_nx") % fx)
    blocks = cube.df.crossJoin(F.broadcast(size)).where(inside).withColumns({"by": F.floor(F.col("y_idx") / fy).cast("int"), "bx": F.floor(F.col("x_idx") / fx).cast("int")})
    return blocks.groupBy("time", "by", "bx").agg(F.avg("y").alias("y"), F.avg("x").alias("x"), *[F.avg(v).alias(v) for v in cube.variables])


def coarsen_to(cube: Cube, most: int) -> DataFrame:
    """Means of blocks as large as they have to be for at most ``most`` rows and columns."""
    ny, nx = cube.pixels().agg(F.max("y_idx") + 1, F.max("x_idx") + 1).first()
    return coarsen_mean(cube, max(1, -(-(ny or 1) // most)), max(1, -(-(nx or 1) // most)))


@verb
def smooth_mean(cube: Cube, k: int) -> DataFrame:
    """Mean of the k x k box around each pixel (k odd); missing unless all its cells have values.

    Each cell is sent to the k * k boxes that it is part of and averaged there.
    """
    if k % 2 == 0:
        raise ValueError("the box needs an odd side")
    r, v = k // 2, cube.variable
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-r, r + 1) for j in range(-r, r + 1)]))
    sent = cube.df.where(F.col(v).isNotNull()).select("t_idx", "y_idx", "x_idx", v, offsets.alias("o"))
    sums = sent.groupBy("t_idx", (F.col("y_idx") + F.col("o.dy")).alias("y_idx"), (F.col("x_idx") + F.col("o.dx")).alias("x_idx")).agg(F.when(F.count(v) == k * k, F.avg(v)).alias(f"{v}_smooth"))
    return cube.df.join(sums, [*POSITIONS], "left").select(*KEYS, f"{v}_smooth")


@verb
def resample_mean(cube: Cube, unit: str = "week") -> DataFrame:
    """Means by calendar period; a period without values is null."""
    return cube.df.groupBy(F.to_date(F.date_trunc(unit, "time")).alias("time"), *PIXEL).agg(*[F.avg(v).alias(v) for v in cube.variables])


def ndvi(nir: Column, red: Column, eps: float | None = None) -> Column:
    """(nir - red) / (nir + red); with ``eps`` in the denominator it is defined at 0 too."""
    return F.try_divide(nir - red, nir + red) if eps is None else F.try_divide(nir - red, nir + red + eps)


def band_cube(df: DataFrame, bands: list[str]) -> Cube:
    """A cube with one variable per band from cells ``(time, y, x, band, value)``."""
    wide = df.groupBy(*KEYS).pivot("band", bands).agg(F.first("value"))
    return dense(wide, tuple(bands))


def kelvin_to_celsius(v: Column) -> Column:
    return v - 273.15


def rasterize(points: DataFrame, grid: Cube, how: str = "sum") -> DataFrame:
    """Points ``(time, y, x, value)`` reduced on the nearest cells of a grid; cells without points are null.

    The nearest coordinate of each axis is found on the axis alone; points outside go to the edge.
    """
    if how not in ("sum", "mean", "count"):
        raise ValueError("how is sum, mean or count")
    p = points.select(*KEYS, "value")
    for axis in KEYS:
        coords = grid.df.select(F.col(axis).alias("_c")).distinct().agg(F.sort_array(F.collect_list("_c")).alias("_axis"))
        near = nearest("_axis", F.col(axis), (lambda c, v: F.abs(F.datediff(c, v))) if axis == "time" else None)
        p = p.crossJoin(F.broadcast(coords)).withColumn(axis, near).drop("_axis")
    value = {"sum": F.sum("value"), "mean": F.avg("value"), "count": F.count("value").cast("double")}[how]
    return grid.df.select(*KEYS).join(p.groupBy(*KEYS).agg(value.alias("value")), [*KEYS], "left")


def center_pixel(cube: Cube) -> DataFrame:
    """Series of the pixel at half the size of either axis."""
    mid = cube.pixels().agg(F.floor((F.max("y_idx") + 1) / 2).alias("_cy"), F.floor((F.max("x_idx") + 1) / 2).alias("_cx"))
    return cube.df.crossJoin(F.broadcast(mid)).where((F.col("y_idx") == F.col("_cy")) & (F.col("x_idx") == F.col("_cx"))).select("time", "t_idx", F.col(cube.variable).alias("center"))


def valid_footprint(cube: Cube) -> DataFrame:
    """The index box of cells that have a value at some time."""
    v = cube.variable
    return cube.df.where(F.col(v).isNotNull()).agg(*[f(c).alias(f"{n}_{c}") for c in ("y_idx", "x_idx") for n, f in (("min", F.min), ("max", F.max))])


@verb
def crop_to_footprint(cube: Cube) -> Cube:
    b = F.broadcast(valid_footprint(cube))
    inside = F.col("y_idx").between(F.col("min_y_idx"), F.col("max_y_idx")) & F.col("x_idx").between(F.col("min_x_idx"), F.col("max_x_idx"))
    return cube.with_df(cube.df.crossJoin(b).where(inside).select(*KEYS, *POSITIONS, *cube.variables))
