"""Choosing entities and preparing what a figure or a report shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dealing import near_pairs
from ..functions.stats import average_rank

PREPARATIONS = ("raw", "anomaly", "zscore", "rank_only")


def event_summary(daily: DataFrame, id_column: str = "id", date: str = "date") -> DataFrame:
    """(event_id, start, end, duration_days, daily_rows) of each event with a date."""
    day = F.to_date(date)
    return daily.groupBy(F.col(id_column).alias("event_id")).agg(F.min(date).alias("start"), F.max(date).alias("end"), (F.datediff(F.max(day), F.min(day)) + 1).alias("duration_days"), F.count(F.lit(1)).alias("daily_rows")).where(F.col("start").isNotNull())


def select_panel(summary: DataFrame, ids: DataFrame | None = None, min_days: int | None = None, max_days: int | None = None, max_events: int | None = None) -> DataFrame:
    """Events of a summary by ids (``ids(event_id)``, given or found by a text search) and duration, in the order of start and id."""
    chosen = summary if ids is None else summary.join(ids.select("event_id").distinct(), "event_id", "left_semi")
    if min_days is not None:
        chosen = chosen.where(F.col("duration_days") >= min_days)
    if max_days is not None:
        chosen = chosen.where(F.col("duration_days") <= max_days)
    chosen = chosen.orderBy("start", "event_id")
    return chosen if max_events is None else chosen.limit(max_events)


def entity_summary(rows: DataFrame, keys: list[str], flags: list[str], variables: list[str]) -> DataFrame:
    """Rows, share of each flag, and mean, least and greatest value of each variable, by entity."""
    shares = [F.avg(F.col(f).cast("double")).alias(f"{f}_fraction") for f in flags]
    stats = [f(v).alias(f"{v}_{name}") for v in variables for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *shares, *stats)


def land_region(lon: Column, lat: Column) -> Column:
    """A coarse region for points known to be on land of the country: the outermost names take what is beyond."""
    return (
        F.when((lat >= 50) & lon.between(-170, -130), "alaska").when(lat.between(18, 23) & lon.between(-161, -154), "hawaii")
        .when(lon < -112, "west").when(lon < -96, "intermountain").when(lon < -84, "central").otherwise("east")
    )


def story(rows: DataFrame, condition: Column, score: str, id_column: str, ascending: bool = False) -> DataFrame:
    """The row with the best score among those that meet a condition, or among all if none does; ties to the smaller id."""
    usable = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(id_column).isNotNull() & (F.abs(F.col(score).cast("double")) != float("inf")))
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return usable.withColumn("_meets", F.coalesce(condition, F.lit(False))).orderBy(F.col("_meets").desc(), order, id_column).limit(1).drop("_meets")


def mismatch_examples(anchors: DataFrame, rows: DataFrame, id_column: str, near: list[str], far: list[str], k: int = 50) -> DataFrame:
    """For each anchor, of its ``k`` nearest rows in one space the one farthest away in the other.

    Columns are standardised by mean and population deviation over ``rows``; ties to the
    smaller id.
    """
    columns = [*near, *far]
    stats = rows.agg(*[e for c in columns for e in (F.avg(c).alias(f"_a_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = lambda cs: F.array(*[(F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}") for c in cs])
    scaled = rows.crossJoin(F.broadcast(stats)).select(F.col(id_column).alias("id"), z(near).alias("p"), z(far).alias("q"))
    # As columns: the rows near an anchor are found in a band of the first one, and no other pair is made.
    names = {"near": [f"_n{i}" for i in range(len(near))], "far": [f"_f{i}" for i in range(len(far))]}
    flat = scaled.select("id", *[F.col("p")[i].alias(c) for i, c in enumerate(names["near"])], *[F.col("q")[i].alias(c) for i, c in enumerate(names["far"])])
    found = near_pairs(anchors.select(F.col(id_column).alias("id")), flat, "id", names["near"], names["far"], k)
    pairs = found.select(F.col("query_id").alias("id_a"), F.col("neighbor_id").alias("id_b"), F.sqrt("d2").alias("near_distance"), F.sqrt("far2").alias("far_distance"))
    nearest = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("id_a").orderBy(F.round("near_distance", 9), "id_b"))).where(F.col("_r") <= k)
    return nearest.withColumn("_f", F.row_number().over(Window.partitionBy("id_a").orderBy(F.round("far_distance", 9).desc(), "id_b"))).where(F.col("_f") == 1).drop("_r", "_f")


def eastward(lon: Column, grid_lon_min: Column | float) -> Column:
    """A longitude on a grid that counts from 0 to 360, if the grid does."""
    least = grid_lon_min if isinstance(grid_lon_min, Column) else F.lit(float(grid_lon_min))
    return F.when((least >= 0) & (lon < 0), lon + 360).otherwise(lon)


def span_climate(entities: DataFrame, cells: DataFrame, variables: list[str]) -> DataFrame:
    """Mean, greatest and least value of each variable of ``cells(time, y, x, ...)`` at an entity's cell during its time.

    ``entities(fire_id, y, x, start, end)`` with the coordinates of their nearest cells.
    Days of the span, not cells, are formed, so the join is on equal keys.
    """
    days = entities.select("fire_id", "y", "x", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("time"))
    values = days.join(cells.select("time", "y", "x", *variables), ["time", "y", "x"])
    stats = [f(v).alias(f"{v}_{name}") for v in variables for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return entities.select("fire_id").join(values.groupBy("fire_id").agg(*stats), "fire_id", "left")


def prepared_pair(series: DataFrame, how: str = "raw", keys: list[str] | None = None) -> DataFrame:
    """``series(keys, x, y)`` without incomplete pairs, as they are, less their means, standardised (sample deviation), or as ranks / (n + 1)."""
    if how not in PREPARATIONS:
        raise ValueError(f"how is one of {PREPARATIONS}")
    keys = keys or []
    full = series.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    w = Window.partitionBy(*keys)
    of = {
        "raw": lambda c: F.col(c),
        "anomaly": lambda c: F.col(c) - F.avg(c).over(w),
        "zscore": lambda c: F.try_divide(F.col(c) - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))),
        "rank_only": lambda c: average_rank(F.col(c), keys) / (F.count(F.lit(1)).over(w) + 1),
    }[how]
    return full.withColumns({c: of(c) for c in ("x", "y")})


def interactions(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Products of pairs of columns as new ones."""
    return rows.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def within_entity(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change from the position before, score by the entity's own mean and population deviation, and share of ranks."""
    w = Window.partitionBy(*keys)
    v = F.col(value)
    change = v - F.lag(value).over(w.orderBy(order))
    z = F.try_divide(v - F.avg(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))
    return series.withColumns({f"{value}_change": change, f"{value}_within_z": z, f"{value}_percentile": average_rank(v, keys) / F.count(value).over(w)})


def composite_profile(profiles: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median and quartiles of profiles at each place of a common grid: ``profiles(keys, grid, value)``."""
    q = lambda p: F.percentile(value, F.lit(p))
    return profiles.groupBy(*keys, "grid").agg(F.count(value).alias("n"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"))
