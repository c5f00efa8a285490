"""Tubes: connected components of a mask in space and time, and their measures."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graph import connected
from ..functions.numbering import numbered
from ..functions.scratch import cut
from ..plans.cube import KEYS, POSITIONS, Cube


def label_tubes(mask: Cube, connectivity: int = 6) -> DataFrame:
    """Cells of the mask with a ``tube_id``, numbered from 1 by each tube's first cell.

    Cells start in runs along time, found by one window; the graph of runs that touch is
    contracted until a small rest is left.  Only run labels and their contacts, not cells,
    go round, and every round is cut.  Tubes are numbered by the time of their first cell.
    """
    if connectivity not in (6, 26):
        raise ValueError("connectivity is 6 or 26")
    on = mask.df.where(mask.variable).select(*KEYS, *POSITIONS)
    size = mask.df.agg((F.max("y_idx").cast("long") + 1).alias("_ny"), (F.max("x_idx").cast("long") + 1).alias("_nx"))
    w = Window.partitionBy("y_idx", "x_idx").orderBy("t_idx")
    on = on.crossJoin(F.broadcast(size)).withColumn("cell", (F.col("t_idx") * F.col("_ny") + F.col("y_idx")) * F.col("_nx") + F.col("x_idx")).drop("_ny", "_nx")
    on = on.withColumn("_g", F.col("t_idx") - F.row_number().over(w))
    runs = cut(on.withColumn("run", F.min("cell").over(Window.partitionBy("y_idx", "x_idx", "_g"))).drop("_g"))
    steps = [(0, 0, 1), (0, 1, 0)] if connectivity == 6 else [d for d in product((-1, 0, 1), repeat=3) if d[1:] > (0, 0)]
    offsets = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(d, "tyx", strict=True)]) for d in steps]))
    shifted = runs.select(F.col("run").alias("u"), "t_idx", "y_idx", "x_idx", offsets.alias("d")).select("u", *[(F.col(f"{n}_idx") + F.col(f"d.{n}")).alias(f"{n}_idx") for n in "tyx"])
    edges = shifted.join(runs.select(*POSITIONS, F.col("run").alias("v")), [*POSITIONS]).select("u", "v").where("u <> v")
    labels = connected(edges, "u", "v")
    named = runs.join(labels, F.col("run") == F.col("node"), "left").withColumn("label", F.coalesce("component", "run")).drop("node", "component")
    # A tube's label is its first cell's number, whose quotient by the pixels of a time is that time.
    firsts = named.where(F.col("cell") == F.col("label")).select("label", "t_idx")
    ids = numbered(firsts, "t_idx", ["label"], "tube_id").select("label", "tube_id")
    return named.join(ids, "label").select(*KEYS, *POSITIONS, "tube_id")


def tube_metrics(tubes: DataFrame) -> DataFrame:
    """Extent of each tube, longest and largest first."""
    per_time = tubes.groupBy("tube_id", "time").agg(F.count(F.lit(1)).alias("cells"), *[f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("min", F.min), ("max", F.max))])
    out = per_time.groupBy("tube_id").agg(
        F.count(F.lit(1)).alias("duration_steps"), F.sum("cells").alias("n_voxels"), F.min("time").alias("time_start"), F.max("time").alias("time_end"),
        F.min("min_y").alias("y_min"), F.max("max_y").alias("y_max"), F.min("min_x").alias("x_min"), F.max("max_x").alias("x_max"),
        F.avg("cells").alias("cells_per_timestep_mean"), F.max("cells").alias("cells_per_timestep_max"),
    )
    return out.orderBy(F.col("duration_steps").desc(), F.col("n_voxels").desc(), "tube_id")


def select_tube(metrics: DataFrame, by: str | int = "longest") -> DataFrame:
    """The longest or largest tube, or the one with an id."""
    if isinstance(by, int):
        return metrics.where(F.col("tube_id") == by)
    order = {"longest": ["duration_steps", "n_voxels"], "largest": ["n_voxels", "duration_steps"]}[by]
    return metrics.orderBy(*[F.col(c).desc() for c in order], "tube_id").limit(1)
