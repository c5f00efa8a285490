"""Alignment in time and space: as-of and nearest joins, interpolation, latest-before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import let
from ..plans.cube import KEYS, Cube

METHODS = ("pad", "backfill", "nearest")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], value: str, method: str = "pad", tolerance_days: int | None = None) -> DataFrame:
    """``left(on, time)`` with the ``value`` of ``right(on, time, value)`` at the last time before (pad), the first after (backfill) or the closer of both.

    Both sides go through one shuffle by ``on`` and one sort: a union with running last and
    first values, without forming any pairs.  Ties of nearest go to the earlier.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    rest = [c for c in left.columns if c not in (*on, "time")]
    a = left.select(*on, "time", F.struct(*rest).alias("_l") if rest else F.lit(True).alias("_l"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.where(F.col(value).isNotNull()).select(*on, "time", F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"))
    both = a.unionByName(b).withColumn("_known", F.when(F.col("_v").isNotNull(), F.struct(F.col("time").alias("t"), F.col("_v").alias("v"))))
    # Equal times: values first when looking back, last when looking ahead, so that both see them.
    back = Window.partitionBy(*on).orderBy("time", F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*on).orderBy("time", F.col("_v").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    marked = both.withColumns({"_p": F.last("_known", True).over(back), "_n": F.first("_known", True).over(ahead)}).where(F.col("_l").isNotNull())
    gap = lambda c: F.abs(F.datediff("time", F.col(f"{c}.t")))
    chosen = {"pad": F.col("_p"), "backfill": F.col("_n"), "nearest": F.when(F.col("_n").isNull() | (gap("_p") <= gap("_n")), F.col("_p")).otherwise(F.col("_n"))}[method]
    out = marked.withColumn("_c", chosen)
    v = F.col("_c.v") if tolerance_days is None else F.when(gap("_c") <= tolerance_days, F.col("_c.v"))
    return out.select(*on, "time", *([f"_l.{c}" for c in rest]), v.alias(value))


def _first(axis: Column, holds: Callable[[Column], Column]) -> Column:
    """Place from 0 of the first element of a sorted array from which on a condition holds, by halving; its length if it never does."""
    rounds = F.greatest(F.lit(1), F.ceil(F.log2(F.size(axis) + F.lit(1.0))).cast("int"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        found = F.coalesce(holds(F.get(axis, mid)), F.lit(True))
        narrowed = F.when(found, F.struct(acc["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
        return F.when(acc["lo"] < acc["hi"], narrowed).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), rounds), F.struct(F.lit(0).alias("lo"), F.size(axis).alias("hi")), halve, lambda acc: acc["lo"])


def nearest(axis: str, value: Column, gap: Callable[[Column, Column], Column] | None = None) -> Column:
    """The element of a sorted array column nearest to a value, the smaller of equals; the first for a missing value.

    Two searches by halving, whatever the length of the axis: where the value falls, and the
    first element as near as the one before it (distances of large numbers may round alike).
    """
    gap = gap or (lambda c, v: F.abs(c - v).cast("double"))
    a = F.col(axis)

    def choose(i: Column) -> Column:
        low, high = F.get(a, i - 1), F.get(a, i)
        left = (i > 0) & ((i >= F.size(a)) | (gap(low, value) <= gap(high, value)))
        return F.when(left, F.get(a, _first(a, lambda c: (c > value) | (gap(c, value) <= gap(low, value))))).otherwise(high)

    return let(_first(a, lambda c: c > value), choose)


def brackets(axis: str, value: Column) -> tuple[Column, Column]:
    """The last element up to a value and the first from it on."""
    return F.array_max(F.filter(axis, lambda c: c <= value)), F.array_min(F.filter(axis, lambda c: c >= value))


def nearest_cell(points: DataFrame, cube: Cube, columns: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Points with the coordinates ``y, x`` of the nearest cell; the axes, not the cells, are sent around."""
    out = points
    for axis, column in zip(("y", "x"), columns, strict=True):
        coords = cube.df.select(axis).distinct().agg(F.sort_array(F.collect_list(axis)).alias("_axis"))
        near = nearest("_axis", F.col(column))
        out = out.crossJoin(F.broadcast(coords)).withColumn(axis, near).drop("_axis")
    return out


def bilinear(points: DataFrame, cube: Cube) -> DataFrame:
    """Values of ``points(point_id, time, py, px)`` between the four cells around; null outside the grid or beside a missing cell."""
    out = points
    for axis in ("y", "x"):
        coords = cube.df.select(axis).distinct().agg(F.sort_array(F.collect_list(F.col(axis).cast("double"))).alias("_axis"))
        below, above = brackets("_axis", F.col(f"p{axis}"))
        out = out.crossJoin(F.broadcast(coords)).withColumns({f"{axis}0": below, f"{axis}1": above}).drop("_axis")
    share = lambda a: F.when(F.col(f"{a}0").isNotNull() & F.col(f"{a}1").isNotNull(), F.coalesce(F.try_divide(F.col(f"p{a}") - F.col(f"{a}0"), F.nullif(F.col(f"{a}1") - F.col(f"{a}0"), F.lit(0.0))), F.lit(0.0)))
    wy, wx = share("y"), share("x")
    corner = F.explode(F.array(*[F.struct(F.col(f"y{i}").alias("y"), F.col(f"x{j}").alias("x"), ((wy if i else 1 - wy) * (wx if j else 1 - wx)).alias("w")) for i in (0, 1) for j in (0, 1)]))
    cells = cube.df.select("time", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col(cube.variable).alias("_v"))
    four = out.withColumn("_c", corner).select("point_id", "time", "_c.*").where(F.col("w") != 0)
    joined = four.join(cells, [*KEYS], "left").groupBy("point_id").agg(F.when(F.count("_v") == F.count(F.lit(1)), F.sum(F.col("_v") * F.col("w"))).alias("value"))
    return points.join(joined, "point_id", "left")


def interpolate_grid(series: DataFrame, keys: list[str], grid: list[float], position: str = "pos", value: str = "value") -> DataFrame:
    """Linear interpolation of each group's ``value(position)`` at fixed positions, flat beyond the ends.

    A group is packed into one sorted array and all grid points are looked up in it.
    """
    packed = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(position).cast("double").alias("p"), F.col(value).cast("double").alias("v")))).alias("_s"))
    at = packed.withColumn("grid", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    low = F.element_at(F.filter("_s", lambda e: e["p"] <= F.col("grid")), -1)
    high = F.get(F.filter("_s", lambda e: e["p"] >= F.col("grid")), F.lit(0))
    at = at.withColumn("_n", F.size("_s")).withColumn("_lo", F.when(F.exists("_s", lambda e: e["p"] <= F.col("grid")), low)).withColumn("_hi", high)
    w = F.try_divide(F.col("grid") - F.col("_lo.p"), F.nullif(F.col("_hi.p") - F.col("_lo.p"), F.lit(0.0)))
    v = F.when(F.col("_lo").isNull(), F.col("_hi.v")).when(F.col("_hi").isNull(), F.col("_lo.v")).otherwise(F.col("_lo.v") + F.coalesce(w, F.lit(0.0)) * (F.col("_hi.v") - F.col("_lo.v")))
    return at.select(*keys, "grid", v.alias(value))


def fill_both_ways(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Gaps filled from before, and those at the beginning from after."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(value, F.coalesce(F.last(value, True).over(back), F.first(value, True).over(ahead)))
