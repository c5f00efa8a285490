"""Rolling statistics against a reference pixel, tail dependence and rank synchrony."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import array_pearson, array_ranks, average_rank, days, interpolated, let, pearson, pearson_over, quantile
from ..plans.cube import KEYS, PIXEL, Cube
from ..plans.pipe import verb
from .reduce import center_pixel


def _day_number() -> F.Column:
    return F.datediff("time", F.lit("1970-01-01"))


@verb
def rolling_corr_vs_center(cube: Cube, window_days: int = 90, min_t: int = 5) -> DataFrame:
    """Correlation with the centre pixel over the closed span [t - window_days, t]; missing below ``min_t`` time steps."""
    cells = cube.df.join(center_pixel(cube).select("t_idx", "center"), "t_idx").withColumn("_day", _day_number())
    w = Window.partitionBy(*PIXEL).orderBy("_day").rangeBetween(-window_days, 0)
    r = F.when(F.count(F.lit(1)).over(w) >= min_t, pearson_over(F.col(cube.variable), F.col("center"), w))
    return cells.select(*KEYS, r.alias("corr"))


@verb
def rolling_stat(cube: Cube, stat: Callable[[pd.Series, pd.Series], float], window_days: int, min_t: int) -> DataFrame:
    """Any function of (values, centre values) over [t - window_days, t], pixel by pixel."""
    v = cube.variable
    cells = cube.df.join(center_pixel(cube).select("t_idx", "center"), "t_idx").select(*KEYS, F.col(v).alias("value"), "center", _day_number().alias("day"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day").reset_index(drop=True)
        first = pdf["day"].searchsorted(pdf["day"] - window_days)
        out = [float(stat(pdf["value"][a : i + 1], pdf["center"][a : i + 1])) if i + 1 - a >= min_t else None for i, a in enumerate(first)]
        return pdf[[*KEYS]].assign(stat=pd.Series(out, dtype="float64"))

    kinds = dict(cells.dtypes)
    return cells.groupBy(*PIXEL).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", stat double")


@verb
def rolling_tail_contrast(cube: Cube, window: int, q: float = 0.8, min_periods: int = 1) -> DataFrame:
    """Variance of the window's values at or above its own quantile, less the variance of all of them."""
    w = cube.along_time().rowsBetween(1 - window, 0)
    v = F.col(cube.variable)
    cells = cube.df.select(*KEYS, F.count(v).over(w).alias("n"), F.var_pop(v).over(w).alias("all"), F.percentile(v, F.lit(q)).over(w).alias("cut"), F.collect_list(v).over(w).alias("vals"))
    tail = F.filter("vals", lambda x: x >= F.col("cut"))
    size = F.size(tail)
    add = lambda f: F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + f(x))
    mean = F.try_divide(add(lambda x: x), F.nullif(size, F.lit(0)))
    cells = cells.withColumn("_m", mean).withColumn("_v", F.try_divide(add(lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.nullif(size, F.lit(0))))
    return cells.select(*KEYS, F.when((F.col("n") >= min_periods) & (size > 0), F.col("_v") - F.col("all")).alias("contrast"))


def windows(cube: Cube, window: str | int | None, ends: list | None = None, stride: int = 1) -> DataFrame:
    """(window_end, time, t_idx): the times of each window.

    None is one window over everything, labelled with the last time; a span 'nD' is closed
    [end - n days, end]; a number is so many positions.  Strides and chosen ends act before
    any cell is joined.
    """
    times = cube.times()
    if window is None:
        last = times.agg(F.max("time").alias("window_end"))
        return times.crossJoin(F.broadcast(last)).select("window_end", "time", "t_idx")
    e = times.select(F.col("time").alias("window_end"), F.col("t_idx").alias("_e")).where(F.col("_e") % stride == 0)
    if ends is not None:
        e = e.where(F.col("window_end").isin(ends))
    if isinstance(window, int):
        inside = F.col("t_idx").between(F.col("_e") - window + 1, F.col("_e"))
    else:
        inside = F.col("time").between(F.date_sub("window_end", days(window)), F.col("window_end"))
    return e.join(times, inside).select("window_end", "time", "t_idx")


def tail_spearman(pairs: DataFrame, keys: list[str], b: float = 0.5, min_t: int = 3) -> DataFrame:
    """Rank correlation of ``u`` and ``v`` inside the common lower and the common upper tail of each group.

    Lower: both at most their b-quantile; upper: both above their (1 - b)-quantile.  A tail
    with fewer than ``min_t`` pairs is null.  Returns keys, bottom, top and bottom_minus_top.
    """
    w = Window.partitionBy(*keys)
    full = pairs.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    cut = full.select(*keys, "u", "v", *[F.percentile(c, F.lit(q)).over(w).alias(f"_{c}{n}") for c in ("u", "v") for n, q in (("lo", b), ("hi", 1 - b))])
    low = (F.col("u") <= F.col("_ulo")) & (F.col("v") <= F.col("_vlo"))
    high = (F.col("u") > F.col("_uhi")) & (F.col("v") > F.col("_vhi"))
    tails = cut.select(*keys, "u", "v", F.explode(F.array_compact(F.array(F.when(low, "bottom"), F.when(high, "top")))).alias("tail"))
    group = [*keys, "tail"]
    ranked = tails.select(*group, average_rank(F.col("u"), group).alias("ru"), average_rank(F.col("v"), group).alias("rv"))
    scored = ranked.groupBy(*group).agg(F.when(F.count(F.lit(1)) >= min_t, pearson(F.col("ru"), F.col("rv"))).alias("r"))
    both = scored.groupBy(*keys).agg(*[F.max(F.when(F.col("tail") == t, F.col("r"))).alias(t) for t in ("bottom", "top")])
    every = pairs.select(*keys).distinct()
    return every.join(both, keys, "left").withColumn("bottom_minus_top", F.col("bottom") - F.col("top"))


def _interpolated(ordered: Column, q: float) -> Column:
    """Linear interpolation between the elements of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    return F.get(ordered, low) + (at - low) * (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - F.get(ordered, low))


def _tail_ranks(pairs: Column, b: float, min_t: int) -> Column:
    """(bottom, top): :func:`tail_spearman` of an array of pairs ``u, v`` without nulls."""
    cuts = F.struct(pairs.alias("z"), F.array_sort(F.transform(pairs, lambda e: e["u"])).alias("u"), F.array_sort(F.transform(pairs, lambda e: e["v"])).alias("v"))

    def tails(w: Column) -> Column:
        edges = F.struct(w["z"].alias("z"), *[_interpolated(w[c], q).alias(f"{c}{n}") for c in "uv" for n, q in (("lo", b), ("hi", 1 - b))])
        low = lambda e: F.filter(e["z"], lambda p: (p["u"] <= e["ulo"]) & (p["v"] <= e["vlo"]))
        high = lambda e: F.filter(e["z"], lambda p: (p["u"] > e["uhi"]) & (p["v"] > e["vhi"]))
        score = lambda t: F.when(F.size(t) >= min_t, array_pearson(array_ranks(F.transform(t, lambda p: p["u"])), array_ranks(F.transform(t, lambda p: p["v"]))))
        return let(edges, lambda e: F.struct(let(low(e), score).alias("bottom"), let(high(e), score).alias("top")))

    return let(cuts, tails)


@verb
def median_split_synchrony(cube: Cube, window: str | int | None = "90D", b: float = 0.5, min_t: int = 5, stride: int = 1, ends: list | None = None) -> DataFrame:
    """Tail rank correlations with the centre pixel in rolling windows with at least ``min_t`` times.

    A pixel's series is one packed array, a window a slice of it: a pixel and window is one
    row, not one for each of its times.
    """
    bounds = windows(cube, window, ends, stride).groupBy("window_end").agg(F.min("t_idx").alias("_w0"), F.max("t_idx").alias("_w1"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_t)
    cells = cube.df.join(center_pixel(cube).select("t_idx", "center"), "t_idx")
    series = cells.groupBy(*PIXEL).agg(F.sort_array(F.collect_list(F.struct("t_idx", F.col(cube.variable).alias("u"), F.col("center").alias("v")))).alias("_s"))
    both = series.crossJoin(F.broadcast(bounds)).withColumn("_z", F.filter(F.slice("_s", F.col("_w0") + 1, F.col("_w1") - F.col("_w0") + 1), lambda e: e["u"].isNotNull() & e["v"].isNotNull()))
    scored = both.select("window_end", *PIXEL, F.when(F.size("_z") > 0, _tail_ranks(F.col("_z"), b, min_t)).alias("_t"))
    return scored.select("window_end", *PIXEL, "_t.bottom", "_t.top", (F.col("_t.bottom") - F.col("_t.top")).alias("bottom_minus_top"))


def ghosh_tails(pairs: DataFrame, keys: list[str], bands: int = 2) -> DataFrame:
    """Partial Spearman correlation of each tail band of normalised ranks.

    Ranks are rank / (n + 1).  A band takes the pairs whose rank sum lies between two
    diagonals; its share of the covariance uses the mean and variance of all ranks.
    """
    full = pairs.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    u = full.select(*keys, (average_rank(F.col("u"), keys) / (n + 1)).alias("u"), (average_rank(F.col("v"), keys) / (n + 1)).alias("v"))
    m = u.select(*keys, "u", "v", *[f(c).over(w).alias(f"{p}{c}") for c in ("u", "v") for p, f in (("m", F.avg), ("s", F.var_samp))], F.count(F.lit(1)).over(w).alias("n"))
    total = F.col("u") + F.col("v")
    band = F.least(F.floor(total / 2 * bands), F.lit(bands - 1)).cast("int")
    part = F.sum((F.col("u") - F.col("mu")) * (F.col("v") - F.col("mv")))
    denominator = (F.first("n") - 1) * F.sqrt(F.first("su") * F.first("sv"))
    return m.withColumn("band", band).groupBy(*keys, "band").agg(F.try_divide(part, F.nullif(denominator, F.lit(0.0))).alias("partial"), F.count(F.lit(1)).alias("n_pairs"))


def dominance(bottom: F.Column, top: F.Column, tolerance: float = 0.05) -> F.Column:
    """Which tail is the more dependent."""
    return F.when(bottom - top > tolerance, "lower").when(top - bottom > tolerance, "upper").when(bottom.isNotNull() & top.isNotNull(), "balanced")


def rolling_quantile(cube: Cube, window: int, q: float) -> F.Column:
    """Quantile of the last ``window`` positions, as few as there are."""
    return interpolated(F.sort_array(F.collect_list(cube.variable).over(cube.along_time().rowsBetween(1 - window, 0))), q)


__all__ = ["dominance", "ghosh_tails", "median_split_synchrony", "quantile", "rolling_corr_vs_center", "rolling_quantile", "rolling_stat", "rolling_tail_contrast", "tail_spearman", "windows"]
