"""Cubes: dense grids over time and two spatial axes, held as long DataFrames.

One row is one cell: ``time, y, x`` with their positions ``t_idx, y_idx, x_idx`` and one
column per variable.  A missing value is null, never NaN, and an absent cell is a row with
nulls once a cube is dense.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("time", "y", "x")
POSITIONS = ("t_idx", "y_idx", "x_idx")
PIXEL = ("y", "x")


@dataclass(frozen=True)
class Cube:
    """A frame of cells with the names of its variables.

    ``descending``: spatial axes whose positions run against their coordinates.
    ``attrs``: provenance, such as source and is_synthetic.
    """

    df: DataFrame
    variables: tuple[str, ...] = ("value",)
    descending: tuple[str, ...] = ()
    attrs: dict = field(default_factory=dict)

    @property
    def variable(self) -> str:
        if len(self.variables) != 1:
            raise ValueError(f"name one of the variables {self.variables}")
        return self.variables[0]

    def pick(self, name: str | None) -> str:
        """``name``, or the only variable."""
        if name is None:
            return self.variable
        if name not in self.variables:
            raise ValueError(f"no variable {name}; there are {self.variables}")
        return name

    def with_df(self, df: DataFrame, *variables: str) -> Cube:
        return replace(self, df=df, variables=variables or self.variables)

    def with_values(self, **values: Column) -> Cube:
        """The same cells with new variables."""
        return self.with_df(self.df.select(*KEYS, *POSITIONS, *[c.alias(n) for n, c in values.items()]), *values)

    def times(self) -> DataFrame:
        return self.df.select("time", "t_idx").distinct()

    def pixels(self) -> DataFrame:
        return self.df.select("y", "x", "y_idx", "x_idx").distinct()

    def over_pixel(self) -> Window:
        return Window.partitionBy(*PIXEL)

    def along_time(self) -> Window:
        return Window.partitionBy(*PIXEL).orderBy("t_idx")


def clean(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def _positions(values: DataFrame, column: str, name: str, descending: bool = False) -> DataFrame:
    """Positions along an axis; the frame has one row per coordinate, not per cell."""
    order = F.col(column).desc() if descending else F.col(column).asc()
    return values.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("int"))


def dense(df: DataFrame, variables: tuple[str, ...] = ("value",), descending: tuple[str, ...] = (), attrs: dict | None = None, axes: DataFrame | None = None) -> Cube:
    """A cube with a row for each time and each pixel that occur in ``df(time, y, x, ...)``.

    Only the axes are crossed; the cells join them by key.  ``axes`` has the same keys as
    ``df`` where they are had for less, such as the rows that ``df`` aggregates.
    """
    cells = df.select(*KEYS, *[clean(F.col(v).cast("double")).alias(v) for v in variables])
    axes = cells if axes is None else axes
    times = _positions(axes.select("time").distinct(), "time", "t_idx")
    pixels = axes.select(*PIXEL).distinct()
    ys = _positions(pixels.select("y").distinct(), "y", "y_idx", "y" in descending)
    xs = _positions(pixels.select("x").distinct(), "x", "x_idx", "x" in descending)
    grid = pixels.join(ys, "y").join(xs, "x").crossJoin(times)
    return Cube(grid.join(cells, [*KEYS], "left").select(*KEYS, *POSITIONS, *variables), tuple(variables), tuple(descending), dict(attrs or {}))


def infer_dims(columns: list[str], types: dict[str, str]) -> tuple[str, str, str]:
    """Names of the time, y and x columns of a frame by convention.

    Time is ``time``, ``t``, ``date`` or ``datetime``, else the first date-like column; y and
    x are ``y/x``, ``lat/lon`` or ``latitude/longitude``.  Two candidates for one axis are an
    error unless one has the canonical name.
    """
    def one(axis: str, names: tuple[str, ...]) -> str | None:
        found = [n for n in names if n in columns]
        if axis in found or len(found) == 1:
            return axis if axis in found else found[0]
        if found:
            raise ValueError(f"several columns could be {axis}: {found}")
        return None

    time = one("time", ("time", "t", "date", "datetime", "day", "valid_time")) or next((c for c in columns if types[c].startswith(("timestamp", "date"))), None)
    y, x = one("y", ("y", "lat", "latitude")), one("x", ("x", "lon", "longitude"))
    if not (time and y and x):
        raise ValueError(f"no time, y and x among {columns}")
    return time, y, x


def from_frame(df: DataFrame, variables: tuple[str, ...], attrs: dict | None = None, descending: tuple[str, ...] = ()) -> Cube:
    """A dense cube from a frame whose axes go by any of the usual names."""
    time, y, x = infer_dims(df.columns, dict(df.dtypes))
    return dense(df.withColumnsRenamed({time: "time", y: "y", x: "x"}), variables, descending, attrs)


def merge(left: Cube, right: Cube, how: str = "inner") -> Cube:
    """Two cubes as one with the variables of both, aligned on their keys.

    ``how``: inner or outer, or exact (an action), which refuses cubes whose cells differ;
    positions come from the merged axes.
    """
    if how == "exact":
        odd = left.df.select(*KEYS).join(right.df.select(*KEYS), [*KEYS], "left_anti").unionByName(right.df.select(*KEYS).join(left.df.select(*KEYS), [*KEYS], "left_anti"))
        if not odd.isEmpty():
            raise ValueError("the cubes' cells differ")
        how = "inner"
    twice = set(left.variables) & set(right.variables)
    if twice:
        raise ValueError(f"variables in both cubes: {sorted(twice)}")
    both = left.df.select(*KEYS, *left.variables).join(right.df.select(*KEYS, *right.variables), [*KEYS], "full" if how == "outer" else how)
    return dense(both, (*left.variables, *right.variables), left.descending, left.attrs)
