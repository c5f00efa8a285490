"""Reading and writing cubes: Parquet scans with pushdown, bands, tiles, checkpointed batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.cube import KEYS, Cube, dense, infer_dims
from .aoi import Box, inside, padded

# Names of a kind of temperature in the known sources.
TEMPERATURES = {"gridmet": {"mean": "tmmx", "min": "tmmn", "max": "tmmx"}, "prism": {"mean": "tmean", "min": "tmin", "max": "tmax"}}


def temperature_variable(source: str, kind: str = "mean") -> str:
    """The column that holds a kind of temperature; where a source has no mean it is the maximum."""
    try:
        return TEMPERATURES[source][kind]
    except KeyError:
        raise ValueError(f"no {kind} temperature in {source}") from None


def read_cells(spark: SparkSession, path: str | list[str], variables: list[str] | None = None, box: Box | None = None, start: str | None = None, end: str | None = None, wrapped: bool = False, grid_step: float | None = None) -> DataFrame:
    """Cells ``(time, y, x, variables)`` of Parquet files; axes may go by their usual names.

    Time and area become predicates of the scan, and only the wanted columns are read.
    """
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    time, y, x = infer_dims(df.columns, dict(df.dtypes))
    if box is not None:
        df = df.where(inside(padded(box, grid_step) if grid_step else box, x, y, wrapped))
    kind = dict(df.dtypes)[time]
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast(kind))
    names = variables or [c for c in df.columns if c not in (time, y, x)]
    return df.select(F.col(time).alias("time"), F.col(y).alias("y"), F.col(x).alias("x"), *names)


def load_cube(spark: SparkSession, path: str | list[str], variables: list[str] | None = None, freq: str | None = None, require_values: bool = False, **where) -> Cube:
    """A dense cube; ``freq`` takes means by calendar unit; ``require_values`` (an action) refuses an empty area or one without any value."""
    cells = read_cells(spark, path, variables, **where)
    names = [c for c in cells.columns if c not in KEYS]
    if freq is not None:
        cells = cells.groupBy(F.to_date(F.date_trunc(freq, "time")).alias("time"), "y", "x").agg(*[F.avg(v).alias(v) for v in names])
    if require_values:
        n = cells.agg(*[F.count(F.when(~F.isnan(F.col(v).cast("double")), 1)).alias(v) for v in names]).first()
        if not any(n):
            raise ValueError("no values in the chosen area and time")
    return dense(cells, tuple(names), attrs={"source": str(path), "is_synthetic": False, "freq": freq})


def stack_years(frames: Iterable[DataFrame]) -> DataFrame:
    """Yearly frames as one; columns that a year lacks are null there."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def complete_scenes(cells: DataFrame, bands: list[str]) -> DataFrame:
    """Cells of the times at which every band occurs."""
    whole = cells.where(F.col("band").isin(bands)).groupBy("time").agg(F.countDistinct("band").alias("_n")).where(F.col("_n") == len(bands)).select("time")
    return cells.join(whole, "time", "left_semi")


def cloud_filter(scenes: DataFrame, most: float, column: str = "cloud_cover") -> DataFrame:
    return scenes.where(F.col(column) < most)


def drop_bad_times(cells: DataFrame, value: str = "value") -> DataFrame:
    """Cells of the times that have any readable value; without one at all it is an error when acted upon."""
    good = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).select("time").distinct()
    return cells.join(good, "time", "left_semi")


def tiles(df: DataFrame, days: int, cells: float) -> DataFrame:
    """Half-open tiles in time and space as partitioning columns."""
    return df.withColumns({"time_tile": F.floor(F.datediff("time", F.lit("1970-01-01")) / days).cast("int"), "y_tile": F.floor(F.col("y") / cells).cast("int"), "x_tile": F.floor(F.col("x") / cells).cast("int")})


def tiled_statistics(df: DataFrame, value: str, days: int, cells: float) -> DataFrame:
    """Count, mean and population variance of each tile."""
    return tiles(df, days, cells).groupBy("time_tile", "y_tile", "x_tile").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def merged_statistics(df: DataFrame, value: str, days: int, by: list[str]) -> DataFrame:
    """Count, mean and population variance by ``by``, from counts, means and squared deviations of tiles in time merged one with another.

    What a tile leaves is three numbers for each group, so a stream of tiles needs no cell twice.
    """
    part = df.withColumn("time_tile", F.floor(F.datediff("time", F.lit("1970-01-01")) / days)).groupBy(*by, "time_tile").agg(F.count(value).alias("k"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("s")).where("k > 0")
    total = part.groupBy(*by).agg(F.sum("k").alias("n"), F.try_divide(F.sum(F.col("k") * F.col("m")), F.sum("k")).alias("mean"), F.sum("s").alias("_within"), F.sum(F.col("k") * F.col("m") * F.col("m")).alias("_squares"))
    spread = (F.col("_within") + F.col("_squares") - F.col("n") * F.col("mean") * F.col("mean")) / F.col("n")
    empty = df.select(*by).distinct()
    return empty.join(total.select(*by, "n", "mean", F.greatest(F.lit(0.0), spread).alias("variance")), by, "left")


def write_cube(cube: Cube, path: str, days: int = 365, cells: float = 256.0, mode: str = "overwrite") -> Cube:
    """Write a cube by tiles and hand it on."""
    t = tiles(cube.df.select(*KEYS, *cube.variables), days, cells)
    t.repartition("time_tile", "y_tile", "x_tile").write.mode(mode).partitionBy("time_tile", "y_tile", "x_tile").parquet(path)
    return cube


def write_batches(spark: SparkSession, batches: dict[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Results by named batch, each its own partition; batches that are there already are not computed again."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, make in batches.items():
        target = f"{path}/batch={name}"
        done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            make().write.mode("overwrite").parquet(target)
    return spark.read.parquet(path)


def _on_grid(e: DataFrame, **more: Column) -> DataFrame:
    """Events with their day and the place of their user on a grid."""
    keys = {"time": F.to_date("ts"), "y": F.col("user_id") % 5, "x": F.floor(F.col("user_id") / 5), **more}
    return e.select(*[c.alias(n) for n, c in keys.items()], "event_id", "value")


def _means(rows: DataFrame) -> DataFrame:
    """Means of cells, each added up in the order of its events.

    A sum of doubles depends on its order, and a mean at a threshold, or tied with another
    one, would otherwise go by how the rows are cut into partitions.  The running mean of a
    window keeps the order, which an aggregation by hash gives up when its memory is full;
    the last one is the cell's, and long cells spill.
    """
    keys = [c for c in rows.columns if c not in ("event_id", "value")]
    order = Window.partitionBy(*keys).orderBy("event_id")
    so_far = F.avg("value").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(*keys, so_far.alias("value"), F.lead(F.lit(True)).over(order).isNull().alias("_last")).where("_last").drop("_last")


def _kind(spark: SparkSession, sf_dir: str, event_type: str | None) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _on_grid(e if event_type is None else e.where(F.col("event_type") == event_type))


def demo_cells(spark: SparkSession, sf_dir: str, event_type: str | None = "view") -> DataFrame:
    """Daily means of one kind of event, or of all, on a grid of users."""
    return _means(_kind(spark, sf_dir, event_type))


def demo_cube(spark: SparkSession, sf_dir: str, event_type: str | None = "view") -> Cube:
    rows = _kind(spark, sf_dir, event_type)
    return dense(_means(rows), attrs={"source": "events", "is_synthetic": True}, axes=rows)


def demo_vase(spark: SparkSession, times: list, half: float = 3.0, center: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Stacked squares that shrink with time: (time, ring)."""
    cx, cy = center
    rows = []
    for i, t in enumerate(times):
        h = half * (1 - i / (2 * max(1, len(times))))
        rows.append((t, [{"x": cx + sx * h, "y": cy + sy * h} for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]))
    kind = "date" if hasattr(times[0], "year") and not hasattr(times[0], "hour") else "timestamp_ntz"
    return spark.createDataFrame(rows, f"time {kind}, ring array<struct<x:double,y:double>>")


def band_cube_cells(spark: SparkSession, sf_dir: str, bands: list[str]) -> DataFrame:
    """Daily means per kind of event as cells with a band."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin(bands))
    return _means(_on_grid(e, band=F.col("event_type")))
