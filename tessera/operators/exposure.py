"""Exposure of entities to their surroundings: zones, summaries, extremes, roles and effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, pearson, quantile


def exposure_zones(burned: DataFrame, grid: DataFrame, days: DataFrame, distance: int) -> DataFrame:
    """Cells of each event and day by zone, on a raster.

    ``burned(event_id, day, y, x)``: cells by the day they were reached; ``grid(y, x)``:
    all cells; ``days(event_id, day)``: the days to report.  Zones: ``active`` (reached that
    day), ``cumulative`` (by then), ``extension`` (not reached, within ``distance`` cells of
    one that is, along either axis).  Each reached cell is sent to its surroundings once.
    """
    first = burned.groupBy("event_id", "y", "x").agg(F.min("day").alias("reached"))
    r = range(-distance, distance + 1)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in r for j in r]))
    near = first.withColumn("o", around).select("event_id", "reached", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    near = near.groupBy("event_id", "y", "x").agg(F.min("reached").alias("near_from")).join(grid, ["y", "x"], "left_semi")
    cells = near.join(first, ["event_id", "y", "x"], "left").join(days, "event_id").where(F.col("near_from") <= F.col("day"))
    inside = F.col("reached") <= F.col("day")
    zones = F.array_compact(F.array(F.when(F.col("reached") == F.col("day"), "active"), F.when(inside, "cumulative"), F.when(~F.coalesce(inside, F.lit(False)), "extension")))
    return cells.select("event_id", "day", "y", "x", F.explode(zones).alias("zone"))


def zone_summary(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, least, greatest, population deviation and count of the values of a zone."""
    v = F.col(value)
    return values.groupBy(*keys).agg(F.avg(v).alias(f"{value}_mean"), F.min(v).alias(f"{value}_minimum"), F.max(v).alias(f"{value}_maximum"), F.stddev_pop(v).alias(f"{value}_std"), F.count(v).alias("sample_cell_count"))


def exposure_flags(rows: DataFrame, keys: list[str], variables: list[str], wind: str, method: str) -> DataFrame:
    """Whether all variables are there, whether there was wind, the methods used, and why something is missing."""
    there = F.lit(True)
    for v in variables:
        there = there & F.col(v).isNotNull()
    out = rows.groupBy(*keys).agg(F.bool_and(there).alias("climate_available"), F.coalesce(F.bool_or(F.col(wind) > 0), F.lit(False)).alias("wind_present"), F.array_join(F.sort_array(F.collect_set(method)), ",").alias("methods"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("failure_reason", F.when(~F.col("climate_available"), F.when(F.col("n") == 0, "no_cells").otherwise("missing_values")))


def group_anomaly(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A value less the median of its group, such as region and month."""
    w = Window.partitionBy(*keys)
    m = F.percentile(value, F.lit(0.5)).over(w)
    return rows.withColumns({f"{value}_median": m, f"{value}_anomaly": F.col(value) - m})


def extreme_flags(rows: DataFrame, high: list[str], low: list[str], q: float = 0.9, accuracy: int | None = None) -> DataFrame:
    """Whether values reach the quantiles of all rows: ``q`` from above, 1 - q from below; thresholds are one row."""
    cut = rows.agg(*[quantile(c, q, accuracy).alias(f"_h_{c}") for c in high], *[quantile(c, 1 - q, accuracy).alias(f"_l_{c}") for c in low])
    flags = {f"{c}_high": F.coalesce(F.col(c) >= F.col(f"_h_{c}"), F.lit(False)) for c in high} | {f"{c}_low": F.coalesce(F.col(c) <= F.col(f"_l_{c}"), F.lit(False)) for c in low}
    return rows.crossJoin(F.broadcast(cut)).withColumns(flags).select(*rows.columns, *flags)


def terminal_features(series: DataFrame, keys: list[str], order: str, value: str, last: int = 3) -> DataFrame:
    """Slope of the last values against their positions, the last value, its score and its share of lesser values."""
    w = Window.partitionBy(*keys)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    v = F.col(value)
    marked = series.select(*keys, value, back.alias("_b"), F.avg(v).over(w).alias("_m"), F.stddev_pop(v).over(w).alias("_s"), average_rank(v, keys).alias("_r"), F.count(v).over(w).alias("_n"))
    tail = F.col("_b") <= last
    x, y = F.when(tail, -F.col("_b").cast("double")), F.when(tail, v)
    n, sx, sy, sxx, sxy = F.count(y), F.sum(x), F.sum(y), F.sum(x * x), F.sum(x * y)
    slope = F.when(n > 1, F.try_divide(n * sxy - sx * sy, F.nullif(n * sxx - sx * sx, F.lit(0.0))))
    at_end = F.col("_b") == 1
    return marked.groupBy(*keys).agg(
        slope.alias("terminal_slope"), F.max(F.when(at_end, v)).alias("terminal_value"),
        F.max(F.when(at_end & (F.col("_s") > 0), (v - F.col("_m")) / F.col("_s"))).alias("terminal_z"), F.max(F.when(at_end, F.col("_r") / F.col("_n"))).alias("terminal_rank"),
    )


def environmental_roles(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Deviation, deviation of steps, and correlation of neighbouring values of each series."""
    w = Window.partitionBy(*keys).orderBy(order)
    steps = series.withColumn("_p", F.lag(value).over(w))
    return steps.groupBy(*keys).agg(F.stddev_pop(value).alias("sd"), F.stddev_pop(F.col(value) - F.col("_p")).alias("sd_of_steps"), pearson(F.col(value), F.col("_p")).alias("lag1"))


def effect_table(rows: DataFrame, predictors: list[str], responses: list[str], least: int = 100) -> DataFrame:
    """Spearman correlations of all pairs over rows with both values; null below ``least`` rows."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.lit(r).alias("response"), F.col(p).cast("double").alias("x"), F.col(r).cast("double").alias("y")) for p in predictors for r in responses])).alias("e")).select("e.*").where("x is not null and y is not null")
    keys = ["predictor", "response"]
    ranked = pairs.select(*keys, average_rank(F.col("x"), keys).alias("rx"), average_rank(F.col("y"), keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= least, pearson(F.col("rx"), F.col("ry"))).alias("rho"))


def alignment_quality(centered: DataFrame, clock: str = "clock") -> DataFrame:
    """How well event clocks line up series ``(clock, fire_id, lag, value)``: peaks near lag 0, spread per lag, and rank."""
    peak = centered.groupBy(clock, "fire_id").agg(F.max_by("lag", F.struct("value", -F.abs("lag"))).alias("_at"))
    near = peak.groupBy(clock).agg(F.count(F.lit(1)).alias("n_fires"), F.avg((F.abs("_at") <= 1).cast("double")).alias("peak_share"))
    spread = centered.groupBy(clock, "lag").agg(F.var_samp("value").alias("_v"), F.count("value").alias("_n")).groupBy(clock).agg(F.avg("_v").alias("mean_variance"), F.min("_n").alias("least_n"))
    return near.join(spread, clock).withColumn("quality_rank", F.rank().over(Window.orderBy(F.col("peak_share").desc(), "mean_variance")))
