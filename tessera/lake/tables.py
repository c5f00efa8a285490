"""Lake tables: schemas, partitions, processing states, quality flags and cohort queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dealing import dealt, distance_sums, points

# Columns of the tables; those up to the bar are required, and the key comes first in its own entry.
TABLES: dict[str, tuple[str, str, str]] = {
    "fire_observations_raw": ("source_name, source_record_id", "source_name string, source_record_id string, observed_at string, ingested_at string, source_version string", "payload_hash string, raw_payload_uri string"),
    "fire_time": ("fire_id, time_index", "fire_id string, time_index long, timestamp string, year long, processing_version string", "active_area_km2 double, cumulative_area_km2 double, geometry_cache_key string"),
    "fire_geometry": ("fire_id, time_index, geometry_version", "fire_id string, time_index long, geometry_version string, geometry_cache_key string, geometry_uri string", "centroid_lon double, centroid_lat double, area_km2 double, qc_flags array<string>"),
    "fire_events": ("fire_id, event_id, event_version", "fire_id string, event_id string, event_version string, event_type string, event_time string", "event_offset_hours double, magnitude double, event_cache_key string, qc_flags array<string>"),
    "fire_traits": ("fire_id, trait_version", "fire_id string, trait_version string, processing_version string", "year long, region string, total_area_km2 double, duration_hours double, peak_growth_km2_per_hour double, geometry_cache_key string, climate_cache_key string, event_cache_key string"),
    "fire_catalog": ("fire_id, catalog_version", "fire_id string, catalog_version string, year long, region string, processing_version string", "latest_manifest_status string, geometry_cache_key string, climate_cache_key string, vase_cache_key string"),
    "vase_slices": ("fire_id, slice_index, vase_version", "fire_id string, slice_index long, timestamp string, vase_version string, vase_cache_key string, climate_cache_key string", "year long, geometry_cache_key string, climate_source string, climate_temporal_resolution string, climate_extraction_method string, ring_area_km2 double, cumulative_area_km2 double, normalized_vase_width double, maximum_temperature_c double, minimum_temperature_c double, vpd_kpa double, wind_speed_m_s double, wind_present boolean, climate_available boolean, climate_failure_reason string"),
    "vase_climate_exposures": ("fire_id, slice_index, exposure_zone, extension_distance_m, climate_version", "fire_id string, slice_index long, exposure_zone string, extension_distance_m double, climate_version string, timestamp string", "year long, event_day long, event_duration_days long, sample_cell_count long, exposure_area_km2 double, ring_area_km2 double, cumulative_area_km2 double, wind_present boolean, climate_available boolean, climate_failure_reason string"),
    "vase_assets": ("asset_id", "asset_id string, fire_id string, asset_type string, asset_uri string, render_version string", "render_cache_key string, vase_cache_key string, created_at string"),
    "cohort_summaries": ("summary_id", "summary_id string, summary_type string, cohort_filter map<string,string>, created_at string", "source_table_uri string, asset_uri string, record_count long"),
    "processing_manifest": ("fire_id, run_id", "fire_id string, run_id string, status string, component_versions map<string,string>, updated_at string", "attempts long, failure_reason string"),
    "processing_failures": ("run_id, fire_id, failed_at", "run_id string, fire_id string, failed_at string, stage string, message string", "retryable boolean, context map<string,string>"),
    "processing_runs": ("run_id", "run_id string, started_at string, processing_version string, output_root string", "completed_at string, git_commit string, config_hash string, status string"),
}

# The states of a run and where each may go; every unfinished one may also fail.
STATES = ("pending", "running", "geometry_complete", "climate_complete", "events_complete", "traits_complete", "assets_complete", "validated", "published", "failed")
NEXT = {
    "pending": "running",
    "running": "geometry_complete",
    "geometry_complete": "climate_complete",
    "climate_complete": "events_complete traits_complete",
    "events_complete": "traits_complete",
    "traits_complete": "assets_complete validated",
    "assets_complete": "validated",
    "validated": "published",
    "published": "",
    "failed": "pending",
}


def primary_key(table: str) -> list[str]:
    return TABLES[table][0].split(", ")


def required(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table][1].split(", ")]


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(TABLES[table][1:]))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def schema_errors(df: DataFrame, table: str) -> list[str]:
    """Missing required columns and columns of another type; nothing is read."""
    want = {f.name: f.dataType for f in schema(table).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    wide = lambda t: T.LongType() if isinstance(t, T.IntegralType) else T.DoubleType() if isinstance(t, T.FractionalType) else t
    missing = [f"missing {c}" for c in required(table) if c not in have]
    return missing + [f"{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and wide(have[c]) != wide(want[c])]


def row_errors(df: DataFrame, table: str) -> DataFrame:
    """Rows with nulls in the key, or whose key occurs more than once, with the reason."""
    key = primary_key(table)
    nulls = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in required(table) if c in df.columns]))
    twice = F.count(F.lit(1)).over(Window.partitionBy(*key)) > 1
    return df.withColumn("errors", F.when(twice, F.array_append(nulls, F.lit("repeated key"))).otherwise(nulls)).where(F.size("errors") > 0)


def region(lon: Column, lat: Column) -> Column:
    """A coarse region from coordinates in degrees; the first rule that holds."""
    return (
        F.when((lat >= 50) & lon.between(-170, -130), "alaska")
        .when(lat.between(18, 23) & lon.between(-161, -154), "hawaii")
        .when(~(lon.between(-125, -66) & lat.between(24, 50)), "outside_conus")
        .when(lon < -112, "west")
        .when(lon < -96, "intermountain")
        .when(lon < -84, "central")
        .otherwise("east")
    )


def spatial_bucket(lon: Column, lat: Column, degrees: float = 1.0) -> Column:
    """Name of the tile of a point, such as n040_w0106."""
    if degrees <= 0:
        raise ValueError("a tile needs a size")
    def part(v: Column, plus: str, minus: str, digits: int) -> Column:
        k = F.floor(v / degrees)
        return F.concat(F.when(k >= 0, plus).otherwise(minus), F.lpad(F.abs(k).cast("string"), digits, "0"))

    return F.concat(part(lat, "n", "s", 3), F.lit("_"), part(lon, "e", "w", 4))


def with_partitions(df: DataFrame, lon: str, lat: str, version: str) -> DataFrame:
    return df.withColumns({"region": region(F.col(lon), F.col(lat)), "spatial_bucket": spatial_bucket(F.col(lon), F.col(lat)), "processing_version": F.lit(version.replace("/", "_"))})


def write_table(df: DataFrame, path: str, mode: str = "overwrite", kind: str = "parquet") -> DataFrame:
    """Write by year, region, tile and version (never by id), and hand the frame on; ``kind`` is parquet, or csv with a header.

    Rows of one partition go to one task, so that a partition is a few files.
    """
    parts = ["year", "region", "spatial_bucket", "processing_version"]
    df.repartition(*[F.col(p) for p in parts]).write.mode(mode).partitionBy(*parts).format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
    return df


def partition_path(table: str, year: int, region_name: str, bucket: str, version: str) -> str:
    if "fire_id" in table.lower():
        raise ValueError("a table is not partitioned by id")
    return f"{table}/year={int(year)}/region={region_name}/spatial_bucket={bucket}/processing_version={version.replace('/', '_')}"


def partition_path_column(table: str, year: Column, region_name: Column, bucket: Column, version: Column) -> Column:
    """:func:`partition_path` of rows."""
    if "fire_id" in table.lower():
        raise ValueError("a table is not partitioned by id")
    return F.concat(F.lit(f"{table}/year="), year.cast("string"), F.lit("/region="), region_name, F.lit("/spatial_bucket="), bucket, F.lit("/processing_version="), F.regexp_replace(version, "/", "_"))


def allowed(status: Column, new: Column) -> Column:
    """Whether a state may follow another."""
    rules = F.map_from_arrays(F.array(*[F.lit(k) for k in NEXT]), F.array(*[F.array(*[F.lit(v) for v in f"{NEXT[k]} {'' if k in ('published', 'failed') else 'failed'}".split()]).cast("array<string>") for k in NEXT]))
    return F.coalesce(F.array_contains(F.element_at(rules, status), new), F.lit(False))


def transitions(manifest: DataFrame, requests: DataFrame) -> DataFrame:
    """``manifest(fire_id, run_id, status, attempts, ...)`` after ``requests(fire_id, run_id, new_status, reason)``.

    A request that is not allowed changes nothing and is marked in ``rejected``; the step
    from pending to running counts as an attempt; only a failure keeps its reason.
    """
    both = manifest.join(requests, ["fire_id", "run_id"], "left")
    asked = F.col("new_status").isNotNull()
    ok = asked & allowed(F.col("status"), F.col("new_status"))
    started = ok & (F.col("status") == "pending") & (F.col("new_status") == "running")
    return both.select(
        "fire_id", "run_id",
        F.when(ok, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        (F.col("attempts") + F.when(started, 1).otherwise(0)).alias("attempts"),
        F.when(ok, F.when(F.col("new_status") == "failed", F.col("reason"))).otherwise(F.col("failure_reason")).alias("failure_reason"),
        (asked & ~ok).alias("rejected"),
    )


def geometry_flags(area: Column, valid: Column, is_empty: Column, newly_added: Column | None = None) -> Column:
    new = newly_added if newly_added is not None else F.lit(False)
    return F.array_compact(F.array(F.when(is_empty, "empty_geometry"), F.when(~valid, "invalid_geometry"), F.when(area.isNull() | (area <= 0), "nonpositive_area"), F.when(new, "newly_added_geometry")))


def climate_flags(observed: Column, expected: Column, variable: str) -> Column:
    missing = 1 - F.try_divide(observed, F.nullif(expected, F.lit(0)))
    return F.array_compact(F.array(F.when(expected <= 0, "invalid_expected_steps").when(missing > 0.05, f"{variable}_missing_gt_5pct").when(missing > 0, f"{variable}_missing_le_5pct")))


def climate_passed(flags: Column) -> Column:
    return ~F.exists(flags, lambda f: F.endswith(f, F.lit("gt_5pct")))


def task_qc(df: DataFrame) -> DataFrame:
    """Flags of rows ``(task, area_km2, is_valid, is_empty, newly_added_geometry, observed_steps, expected_steps, variable)`` by their task.

    Missing metrics count as the worst: invalid, empty, no steps.  A task that nobody knows has a null verdict.
    """
    geometry = geometry_flags(F.col("area_km2"), F.coalesce("is_valid", F.lit(False)), F.coalesce("is_empty", F.lit(True)), F.coalesce("newly_added_geometry", F.lit(False)))
    observed, expected, variable = F.coalesce("observed_steps", F.lit(0)), F.coalesce("expected_steps", F.lit(0)), F.coalesce("variable", F.lit("unknown"))
    missing = 1 - F.try_divide(observed, F.nullif(expected, F.lit(0)))
    climate = F.array_compact(F.array(F.when(expected <= 0, F.lit("invalid_expected_steps")).when(missing > 0.05, F.concat(variable, F.lit("_missing_gt_5pct"))).when(missing > 0, F.concat(variable, F.lit("_missing_le_5pct")))))
    flags = F.when(F.col("task") == "geometry", geometry).when(F.col("task") == "climate", climate)
    passed = F.when(F.col("task") == "geometry", F.size(geometry) == 0).when(F.col("task") == "climate", climate_passed(climate))
    return df.withColumns({"flags": flags, "passed": passed})


def cohort(df: DataFrame, **filters: Any) -> DataFrame:
    """Rows that equal, are among, or satisfy: a value, a list, or a function of the column."""
    for name, want in filters.items():
        c = F.col(name)
        df = df.where(want(c) if isinstance(want, Callable) else c.isin(list(want)) if isinstance(want, (list, tuple, set)) else c == want)
    return df


def medoid(df: DataFrame, id_column: str, traits: list[str], by: list[str] | None = None) -> DataFrame:
    """The record of each group with the least sum of distances to the group's others; ties to the smaller id.

    All distances of a group are needed.  Records travel to the tasks as arrays in the order
    of their groups, and distances are added up tile by tile.
    """
    keys = by or []
    full = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(id_column).alias("a"), *[F.col(t).cast("double").alias(f"_t{i}") for i, t in enumerate(traits)]).dropna()
    t = full.toArrow().sort_by([(f"_k{i}", "ascending") for i in range(len(keys))] + [("a", "ascending")])
    n, fresh = len(t), np.zeros(len(t), bool)
    fresh[:1] = True
    for i in range(len(keys)):
        codes = t[f"_k{i}"].combine_chunks().dictionary_encode().indices.to_numpy()
        fresh[1:] |= codes[1:] != codes[:-1]
    starts = np.flatnonzero(fresh)
    sizes = np.diff(starts, append=n)
    sums = dealt(df.sparkSession, n, (points(t, [f"_t{i}" for i in range(len(traits))]), starts, True), distance_sums, "i long, g long, d double", int((sizes**2).sum()))
    rows = df.sparkSession.createDataFrame(t.select([f"_k{i}" for i in range(len(keys))] + ["a"]).append_column("i", pa.array(np.arange(n))))
    best = sums.join(rows, "i").groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("a", F.struct(F.round("d", 9), F.col("a"))).alias(id_column), F.min("d").alias("total_distance"))
    return best.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], id_column, "total_distance")


def aligned_quantiles(df: DataFrame, value: str, offset: str, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """By offset: count, the median, and other quantiles as the value of the nearest rank (halves to even)."""
    full = df.where(F.col(value).isNotNull() & F.col(offset).isNotNull()).select(offset, F.col(value).cast("double").alias("_v"))
    # Positions come from a sort that can spill, not from a list of all values.
    placed = full.withColumns({"_i": F.row_number().over(Window.partitionBy(offset).orderBy("_v")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(offset))})
    at = lambda k: F.max(F.when(F.col("_i") == k, F.col("_v")))
    rank = lambda q: at(F.bround((F.col("_n") - 1) * F.lit(q)).cast("int"))
    median = (at(F.floor((F.col("_n") - 1) / 2)) + at(F.ceil((F.col("_n") - 1) / 2))) / 2
    return placed.groupBy(offset).agg(F.count(F.lit(1)).alias("count"), *[(median if q == 0.5 else rank(q)).alias(f"q{int(q * 100):02d}") for q in quantiles])


def manifest_split(slices: DataFrame, requested: DataFrame, supported_years: list[int]) -> tuple[DataFrame, DataFrame]:
    """Ids with climate in all slices, and the others with the reason: a year without source, or missing values."""
    done = slices.groupBy("fire_id").agg(F.bool_and("climate_available").alias("all_there"))
    both = requested.select("fire_id", "year").distinct().join(done, "fire_id", "left")
    complete = both.where(F.coalesce("all_there", F.lit(False))).select("fire_id").distinct()
    reason = F.when(~F.col("year").isin(supported_years), "unsupported_year").otherwise("climate_missing")
    failed = both.join(complete, "fire_id", "left_anti").select("fire_id", reason.alias("failure_reason"), F.lit(True).alias("retryable")).distinct()
    return complete, failed


def filled_keys(df: DataFrame, column: str, computed: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), computed))


def population_summaries(traits: DataFrame) -> Mapping[str, DataFrame]:
    """The standard summaries of a trait table."""
    area, days = F.col("total_area_km2"), F.col("duration_hours") / 24.0
    med = lambda c: F.percentile(c, F.lit(0.5))
    q = lambda c, name: [F.percentile(c, F.lit(p)).alias(f"{name}_p{int(p * 100):02d}") for p in (0.01, 0.1, 0.5, 0.9, 0.99)]
    top = lambda order: traits.orderBy(F.col(order).desc(), "fire_id").limit(20)
    named = ["fire_id", "region", "year", "total_area_km2", days.alias("duration_days")]
    return {
        "overall": traits.agg(
            F.count(F.lit(1)).alias("n_fires"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.countDistinct("year").alias("n_years"),
            F.sum(area).alias("total_area_km2"), F.avg(area).alias("mean_area_km2"), med(area).alias("median_area_km2"), F.max(area).alias("max_area_km2"),
            F.avg(days).alias("mean_duration_days"), med(days).alias("median_duration_days"), F.max(days).alias("max_duration_days"),
        ),
        "by_year": traits.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg(area).alias("mean_area_km2"), F.sum(area).alias("total_area_km2")),
        "by_region": traits.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg(area).alias("mean_area_km2"), med(area).alias("median_area_km2"), F.sum(area).alias("total_area_km2"), F.avg(days).alias("mean_duration_days")),
        "by_region_year": traits.groupBy("region", "year").agg(F.count(F.lit(1)).alias("n")),
        "by_status": traits.groupBy(F.coalesce("status", F.lit("unknown")).alias("status") if "status" in traits.columns else F.lit("unknown").alias("status")).agg(F.count(F.lit(1)).alias("n")),
        "largest": top("total_area_km2").select(*named, (F.col("peak_growth_km2_per_hour") * 24.0).alias("peak_growth_km2_per_day")),
        "duration_top": top("duration_hours").select(*named),
        "quantiles": traits.agg(*q(area, "area"), *q(days, "duration")),
        "sample": traits.orderBy(F.md5(F.col("fire_id").cast("string")), "fire_id").limit(12000).select(*named),
    }
