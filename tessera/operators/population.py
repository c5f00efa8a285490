"""Per-entity developmental features, stages, events and labels from slice tables.

A slice table has rows ``(fire_id, slice_index, ring_area_km2, ...)``.  Features that need
the whole series are folds over one packed, sorted array per entity, so each entity costs
one row in one shuffle; nothing is pulled into Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantile

# Stages by relative time.
STAGES = (("early", 0.0, 0.25), ("expansion", 0.25, 0.5), ("mature", 0.5, 0.75), ("terminal", 0.75, 1.01))
LEAST = 1e-9


def slices_from_growth(growth: DataFrame, entity: str, order: list[str], time: str, amount: str) -> DataFrame:
    """Slices with cumulative amount, width (square root of the final share) and position from rows of growth."""
    w = Window.partitionBy(entity).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(entity)
    cumulative, final = F.sum(amount).over(run), F.sum(amount).over(whole)
    return growth.select(
        F.col(entity).alias("fire_id"),
        (F.row_number().over(w) - 1).cast("long").alias("slice_index"),
        F.col(time).alias("timestamp"),
        F.col(amount).alias("ring_area_km2"),
        cumulative.alias("cumulative_area_km2"),
        F.sqrt(F.try_divide(cumulative, F.nullif(final, F.lit(0.0)))).alias("normalized_vase_width"),
    )


def growth_steps(slices: DataFrame) -> DataFrame:
    """Growth of the neighbours in time, acceleration and logarithm."""
    w = Window.partitionBy("fire_id").orderBy("slice_index")
    g = F.col("ring_area_km2")
    return slices.withColumns({"prev_growth": F.lag(g).over(w), "next_growth": F.lead(g).over(w), "acceleration": g - F.lag(g).over(w), "log_growth": F.log1p(g)})


def space_time_volume(slices: DataFrame) -> DataFrame:
    """Mean area of neighbouring slices times the days between them (one at least), summed up."""
    w = Window.partitionBy("fire_id").orderBy("slice_index")
    area = F.col("cumulative_area_km2")
    step = (area + F.lag(area, 1, 0.0).over(w)) / 2 * F.greatest(F.coalesce(F.datediff("timestamp", F.lag("timestamp").over(w)), F.lit(1)), F.lit(1))
    with_step = slices.withColumn("volume_step", step)
    return with_step.withColumn("volume", F.sum("volume_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _at(values: Column, fraction: Column) -> Column:
    """Linear interpolation of an array over [0, 1]."""
    n = F.size(values)
    at = fraction * (n - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
    return a + (at - low) * (b - a)


def _sum(values: Column, f=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def _quantile(values: Column, q: float) -> Column:
    return _at(F.sort_array(values), F.lit(q))


def _starts(active: Column) -> Column:
    """Positions where an array of booleans turns true."""
    return F.filter(F.sequence(F.lit(0), F.size(active) - 1), lambda i: F.get(active, i) & ((i == 0) | ~F.get(active, F.greatest(i - 1, F.lit(0)))))


def _packed(slices: DataFrame) -> DataFrame:
    fields = ["slice_index", "ring_area_km2", "cumulative_area_km2", "normalized_vase_width", "timestamp"]
    p = slices.groupBy("fire_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_s"))
    clip = lambda c: F.transform("_s", lambda e: F.greatest(F.coalesce(e[c], F.lit(0.0)), F.lit(0.0)))
    # A missing cumulative area takes the last known one, which is the largest so far, as it never falls.
    known = F.transform("_s", lambda e: F.coalesce(e["cumulative_area_km2"], F.lit(0.0)))
    filled = F.transform(known, lambda x, i: F.array_max(F.slice(known, F.lit(1), i + 1)))
    holed = F.exists("_s", lambda e: e["cumulative_area_km2"].isNull())
    p = p.withColumns({"growth": clip("ring_area_km2"), "cumulative": F.when(holed, filled).otherwise(known), "width": clip("normalized_vase_width")})
    return p.withColumns({"obs": F.size("growth"), "peak": F.array_max("growth")})


def features(slices: DataFrame, traits: DataFrame, profile_points: int = 11) -> DataFrame:
    """One row of shape features per entity; ``traits(fire_id, year, region, total_area_km2, duration_days, peak_growth_km2_per_day)``."""
    p = _packed(slices).join(traits, "fire_id")
    p = p.withColumn("final_area_km2", F.greatest("total_area_km2", F.array_max("cumulative"), F.lit(LEAST))).withColumn("duration_days", F.greatest(F.col("duration_days").cast("double"), F.lit(0.0)))
    final = F.col("final_area_km2")
    rel = lambda i: F.when(F.col("obs") == 1, 0.5).otherwise(i / F.greatest(F.col("obs") - 1, F.lit(1)))
    p = p.withColumns(
        {
            "fraction": F.transform("growth", lambda g: g / final),
            "share": F.transform("cumulative", lambda c: c / final),
            "dw": F.when(F.col("obs") > 1, F.zip_with(F.slice("width", 2, F.col("obs")), F.slice("width", 1, F.greatest(F.col("obs") - 1, F.lit(1))), lambda b, a: b - a)).otherwise(F.array(F.lit(0.0))),
            "cut": F.greatest(_quantile(F.col("growth"), 0.75), F.col("peak") * 0.25, F.lit(LEAST)),
        }
    )
    p = p.withColumns(
        {
            "ddw": F.when(F.size("dw") > 1, F.zip_with(F.slice("dw", 2, F.size("dw")), F.slice("dw", 1, F.greatest(F.size("dw") - 1, F.lit(1))), lambda b, a: b - a)).otherwise(F.array(F.lit(0.0))),
            "pulse_count": F.when(F.col("peak") > 0, F.size(_starts(F.transform("growth", lambda g: g >= F.col("cut"))))).otherwise(0),
            "peak_idx": F.array_position("growth", F.col("peak")).cast("int") - 1,
        }
    )
    positive = F.filter("fraction", lambda x: x > 0)
    radius = F.sqrt(final / F.lit(3.141592653589793))
    late = F.filter(F.transform("fraction", lambda x, i: F.when(rel(i) >= 0.75, x).otherwise(0.0)), lambda x: x > 0)
    grid = [i / (profile_points - 1) for i in range(profile_points)]
    return p.select(
        "fire_id", "year", "region", "final_area_km2", "duration_days", "peak_growth_km2_per_day",
        F.col("obs").cast("long").alias("observation_count"),
        F.col("pulse_count").cast("long").alias("pulse_count"),
        F.greatest(F.col("pulse_count") - 1, F.lit(0)).cast("long").alias("reactivation_count"),
        (F.col("peak_idx") / F.greatest(F.col("obs") - 1, F.lit(1))).alias("peak_timing"),
        _at(F.col("share"), F.lit(0.5)).alias("front_loaded_fraction"),
        _sum(late).alias("late_growth_fraction"),
        F.when(F.col("peak") > 0, F.element_at("growth", -1) / F.col("peak")).otherwise(0.0).alias("terminal_taper_fraction"),
        F.when(F.size(positive) > 0, -_sum(positive, lambda x: x * F.log(x)) / F.log(F.greatest(F.col("obs"), F.lit(2)).cast("double"))).otherwise(0.0).alias("growth_entropy"),
        (_sum(F.col("dw"), F.abs) / F.size("dw")).alias("developmental_velocity"),
        (_sum(F.col("ddw"), F.abs) / F.size("ddw")).alias("developmental_acceleration"),
        *[_at(F.col("width"), F.lit(q)).alias(f"width_at_{n}") for q, n in ((0.25, "quarter"), (0.5, "half"), (0.75, "three_quarter"))],
        (F.col("duration_days") / F.greatest(2 * radius, F.lit(0.1))).alias("slenderness_days_per_width"),
        *[_at(F.col("width"), F.lit(g)).alias(f"width_p{i:02d}") for i, g in enumerate(grid)],
        *[_at(F.col("fraction"), F.lit(g)).alias(f"growth_p{i:02d}") for i, g in enumerate(grid)],
    )


def shape_labels(feats: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Features with a label; the thresholds are quantiles over everyone, one row that is sent to all."""
    cut = feats.agg(
        quantile("final_area_km2", 0.75, accuracy).alias("_a75"), quantile("final_area_km2", 0.9, accuracy).alias("_a90"),
        quantile("duration_days", 0.5, accuracy).alias("_d50"), quantile("slenderness_days_per_width", 0.75, accuracy).alias("_s75"),
    )
    c = F.col
    # The labels, their order and the thresholds of their rules.
    label = (
        F.when((c("observation_count") <= 1) | (c("duration_days") <= 1), "single flash")
        .when((c("slenderness_days_per_width") >= c("_s75")) & (c("final_area_km2") <= c("_a75")), "skinny persistent")
        .when((c("final_area_km2") >= c("_a90")) & (c("duration_days") <= c("_d50")), "broad rapid")
        .when((c("pulse_count") >= 3) | (c("observation_count") >= 6), "multi-pulse complex")
        .when(c("peak_timing") >= 0.66, "late surge")
        .when((c("front_loaded_fraction") >= 0.75) & (c("terminal_taper_fraction") <= 0.35), "front-loaded plateau")
        .otherwise("compact steady")
    )
    return feats.crossJoin(F.broadcast(cut)).withColumn("shape_label", label).drop("_a75", "_a90", "_d50", "_s75")


def relative_time(slices: DataFrame) -> DataFrame:
    """Slices with their place in the entity's life, from 0 to 1; 0.5 for a single one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("fire_id"))
    at = F.row_number().over(Window.partitionBy("fire_id").orderBy("slice_index")) - 1
    return slices.withColumn("relative_time", F.when(n == 1, 0.5).otherwise(at / F.greatest(n - 1, F.lit(1))))


def stage_table(slices: DataFrame, feats: DataFrame) -> DataFrame:
    """Growth, width and observations of each entity's stages."""
    t = F.col("relative_time")
    stage = F.when(F.lit(False), "")
    for name, lo, hi in STAGES:
        stage = stage.when((t >= lo) & (t < hi), name)
    mid = F.when(F.lit(False), 0.0)
    for name, lo, hi in STAGES:
        mid = mid.when(F.col("stage") == name, (lo + min(hi, 1.0)) / 2)
    width = F.greatest(F.coalesce("normalized_vase_width", F.lit(0.0)), F.lit(0.0))
    growth = F.greatest(F.coalesce("ring_area_km2", F.lit(0.0)), F.lit(0.0))
    rows = relative_time(slices).withColumn("stage", stage).join(feats.select("fire_id", "final_area_km2"), "fire_id")
    out = rows.groupBy("fire_id", "stage").agg(
        F.sum(growth / F.col("final_area_km2")).alias("stage_growth_fraction"), F.avg(width).alias("stage_width_mean"),
        (F.max(width) - F.min(width)).alias("stage_width_change"), F.count(F.lit(1)).alias("stage_observation_count"),
    )
    return out.withColumn("stage_midpoint", mid)


def geometry_events(slices: DataFrame, feats: DataFrame) -> DataFrame:
    """Named moments of each entity's development: (fire_id, event_name, slice_index, relative_time)."""
    p = _packed(slices).join(feats.select("fire_id", "final_area_km2"), "fire_id")
    n, g, peak, final = F.col("obs"), F.col("growth"), F.col("peak"), F.col("final_area_km2")
    index = F.sequence(F.lit(0), n - 1)
    first = lambda f: F.coalesce(F.get(F.filter(index, f), F.lit(0)), F.lit(0))
    peak_at = F.when(peak > 0, F.array_position(g, peak).cast("int") - 1).otherwise(0)
    burst = F.transform(g, lambda x: x >= F.greatest(peak * 0.25, F.lit(LEAST)))
    meaningful = F.filter(index, lambda i: F.get(g, i) >= F.greatest(peak * 0.1, final * 0.01, F.lit(LEAST)))
    p = p.withColumns({"peak_at": peak_at, "starts": _starts(burst)})
    slow = F.get(F.filter(index, lambda i: (i > F.col("peak_at")) & (F.get(g, i) <= peak * 0.25)), F.lit(0))
    several = (n > 2) & (peak > 0)
    specs = {
        "first_observed_development": F.lit(0),
        "emergence_5pct_area": first(lambda i: F.get(F.col("cumulative"), i) / final >= 0.05),
        "first_major_burst": F.when(peak > 0, F.coalesce(F.get("starts", F.lit(0)), F.lit(0))).otherwise(0),
        "peak_expansion": F.col("peak_at"),
        "final_meaningful_expansion": F.when((peak > 0) & (F.size(meaningful) > 0), F.array_max(meaningful)).otherwise(n - 1),
        "geometric_quiescence": n - 1,
        "slowdown_after_peak": F.when(several, slow),
        "secondary_burst": F.when(several & (F.size("starts") > 1), F.get("starts", F.lit(1))),
    }
    rows = p.select("fire_id", "obs", F.explode(F.array(*[F.struct(F.lit(k).alias("event_name"), v.cast("int").alias("slice_index")) for k, v in specs.items()])).alias("_e")).select("fire_id", "obs", "_e.*").where("slice_index is not null")
    at = F.when(F.col("obs") == 1, 0.5).otherwise(F.col("slice_index") / F.greatest(F.col("obs") - 1, F.lit(1)))
    return rows.select("fire_id", "event_name", F.col("slice_index").cast("long").alias("slice_index"), at.alias("relative_time"))


def days_above(slices: DataFrame) -> DataFrame:
    """The other pulse count: days at or above max(0.1, a quarter of the peak, the upper quartile)."""
    w = Window.partitionBy("fire_id")
    g = F.col("ring_area_km2")
    cut = F.greatest(F.lit(0.1), 0.25 * F.max(g).over(w), F.percentile(g, F.lit(0.75)).over(w))
    return slices.withColumn("_c", cut).groupBy("fire_id").agg(F.count(F.when(g >= F.col("_c"), 1)).alias("pulse_days"))


def duration_bin(days: Column) -> Column:
    return F.when(days <= 1, "1").when(days <= 3, "2-3").when(days <= 7, "4-7").otherwise("8+")


def terciles(df: DataFrame, value: str, name: str = "tercile", accuracy: int | None = None) -> DataFrame:
    """low, middle or high by the values at the thirds."""
    cut = df.agg(quantile(value, 1 / 3, accuracy).alias("_a"), quantile(value, 2 / 3, accuracy).alias("_b"))
    v = F.col(value)
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.when(v <= F.col("_a"), "low").when(v <= F.col("_b"), "middle").when(v.isNotNull(), "high")).drop("_a", "_b")


def phase_pivot(slices: DataFrame, value: str) -> DataFrame:
    """Mean of a value in the first, second and last third of each entity's life."""
    t = F.col("relative_time")
    phase = F.when(t <= 1 / 3, "early").when(t <= 2 / 3, "middle").otherwise("late")
    return relative_time(slices).withColumn("phase", phase).groupBy("fire_id").pivot("phase", ["early", "middle", "late"]).agg(F.avg(value))


def local_maxima(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows at least as large as both neighbours; the ends have one neighbour."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    return series.withColumns({"_b": F.lag(v).over(w), "_a": F.lead(v).over(w)}).where((F.col("_b").isNull() | (v >= F.col("_b"))) & (F.col("_a").isNull() | (v >= F.col("_a")))).drop("_b", "_a")


def contrast_pairs(feats: DataFrame, size: str, value: str, bins: int = 40, least: int = 20, accuracy: int | None = None) -> DataFrame:
    """In each quantile bin of ``size`` with enough members, the ids with the least and the greatest ``value``."""
    edges = feats.agg(quantile(size, F.array(*[F.lit(i / bins) for i in range(1, bins)]), accuracy).alias("_e"))
    bin_ = F.size(F.filter("_e", lambda e: e <= F.col(size)))
    return feats.crossJoin(F.broadcast(edges)).withColumn("bin", bin_).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("fire_id", F.struct(value, "fire_id")).alias("low_id"), F.max_by("fire_id", F.struct(value, "fire_id")).alias("high_id"), (F.max(value) - F.min(value)).alias("gap")
    ).where(F.col("n") >= least)


def stratified_sample(df: DataFrame, stratum: str, id_column: str, per_stratum: int, total: int) -> DataFrame:
    """The first by hash of each stratum, topped up with the next ones over all strata."""
    h = F.md5(F.col(id_column).cast("string"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(h, id_column)))
    return ranked.orderBy((F.col("_r") > per_stratum).cast("int"), h, id_column).limit(total).drop("_r")


def text_search(df: DataFrame, pattern: str, id_column: str, columns: list[str] | None = None) -> DataFrame:
    """Ids whose text columns match a pattern, whatever the case, with the columns that did."""
    names = columns or [c for c, t in df.dtypes if t == "string"]
    found = F.array_compact(F.array(*[F.when(F.rlike(F.col(c), F.lit(f"(?i){pattern}")), F.lit(c)) for c in names]))
    return df.select(id_column, found.alias("evidence")).where(F.size("evidence") > 0)


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Count, least, median, mean and greatest of each metric."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("_e")).select("_e.*")
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.percentile("v", F.lit(0.5)).alias("median"), F.avg("v").alias("mean"), F.max("v").alias("max"))
