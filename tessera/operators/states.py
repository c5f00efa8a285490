"""States of cells: thresholds, quantiles, truth, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import interpolated, steps
from ..plans.cube import KEYS, PIXEL, POSITIONS, Cube
from ..plans.pipe import verb
from .rolling import rolling_quantile

STATE = ("state", "magnitude", "threshold")


def _state(cube: Cube, value: Column, threshold: Column, direction: str) -> Cube:
    """The signed distance from the threshold is kept for non-events; a missing value is a non-event."""
    if direction not in ("above", "below"):
        raise ValueError("direction is above or below")
    hit, size = (value >= threshold, value - threshold) if direction == "above" else (value <= threshold, threshold - value)
    return cube.with_values(state=F.coalesce(hit, F.lit(False)), magnitude=size, threshold=threshold)


@verb
def threshold_state(cube: Cube, threshold: float | DataFrame, direction: str = "above", variable: str | None = None) -> Cube:
    """Cells at or beyond a threshold: a number, or a frame ``(y, x, threshold)``, optionally by time."""
    v = F.col(cube.pick(variable))
    if isinstance(threshold, DataFrame):
        on = [k for k in KEYS if k in threshold.columns]
        cube = cube.with_df(cube.df.join(threshold.select(*on, F.col("threshold").cast("double").alias("_thr")), on, "left"))
        return _state(cube, v, F.col("_thr"), direction)
    return _state(cube, v, F.lit(float(threshold)), direction)


exceedance = threshold_state


@verb
def quantile_state(cube: Cube, q: float = 0.9, direction: str = "above", rolling_window: int | None = None, climatology: DataFrame | None = None, variable: str | None = None) -> Cube:
    """Cells beyond a quantile: that of a climatology frame if given, else of a rolling window, else of the pixel's whole series."""
    if climatology is not None:
        return threshold_state(cube, climatology, direction, variable)
    name = cube.pick(variable)
    one = Cube(cube.df.withColumnRenamed(name, "value") if name != "value" else cube.df, ("value",), cube.descending, cube.attrs)
    cut = rolling_quantile(one, rolling_window, q) if rolling_window else interpolated(F.sort_array(F.collect_list("value").over(one.over_pixel())), q)
    with_cut = one.with_df(one.df.withColumn("_thr", cut))
    return _state(with_cut, F.col("value"), F.col("_thr"), direction)


@verb
def binary_state(cube: Cube, variable: str | None = None, missing: bool = True) -> Cube:
    """Whether a value is other than zero; a missing one counts as ``missing``."""
    hit = F.coalesce(F.col(cube.pick(variable)) != 0, F.lit(missing))
    return cube.with_values(state=hit, magnitude=F.when(hit, 1.0).otherwise(0.0), threshold=F.lit(0.0))


@verb
def change_state(cube: Cube, threshold: float, kind: str = "absolute", lag: int | str = 1, variable: str | None = None) -> Cube:
    """Cells whose change since ``lag`` positions before reaches a threshold; relative change divides by the old value."""
    if kind not in ("absolute", "relative"):
        raise ValueError("kind is absolute or relative")
    v = F.col(cube.pick(variable))
    before = F.lag(v, steps(lag, cube.times())).over(cube.along_time())
    delta = v - before if kind == "absolute" else F.try_divide(v - before, F.nullif(before, F.lit(0.0)))
    with_delta = cube.with_df(cube.df.withColumn("_delta", delta))
    return _state(with_delta, F.col("_delta"), F.lit(float(threshold)), "above")


@verb
def heat_stress(cube: Cube, threshold: float) -> DataFrame:
    """A custom verb of the kind users write: magnitude only where the state holds."""
    v = F.col(cube.variable)
    hit = F.coalesce(v >= threshold, F.lit(False))
    return cube.df.select(*KEYS, hit.alias("state"), F.when(hit, v - threshold).otherwise(0.0).alias("magnitude"))


@verb
def state_transitions(states: Cube) -> DataFrame:
    """Counts of (from, to) states of neighbouring times over all pixels, and shares of each from-state."""
    pairs = states.df.select(F.col("state").alias("from_state"), F.lead("state").over(states.along_time()).alias("to_state")).where("to_state is not null")
    counts = pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("from_state").agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(totals), "from_state").select("from_state", "to_state", "n", (F.col("n") / F.col("_all")).alias("probability"))


def states_of(cube: Cube) -> DataFrame:
    return cube.df.select(*KEYS, *POSITIONS, *STATE)


__all__ = ["PIXEL", "STATE", "binary_state", "change_state", "exceedance", "heat_stress", "quantile_state", "state_transitions", "states_of", "threshold_state"]
