"""Registered queries over lake tables, populations, volumes and models.

Customers stand for entities whose orders are their growth: each order is a slice, its
price the area that was added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import keys, tables
from .ml import models
from .operators import align, exposure, geometry, population, reduce, tubes
from .oracles import finished, rounded
from .queries_cube import cube_sql
from .sources.cubes import demo_cube, demo_vase

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SLICES_SQL = """
g AS (SELECT o_custkey AS fire_id, CAST(o_orderdate AS DATE) AS timestamp, o_orderkey, o_totalprice / 1000 AS ring_area_km2 FROM orders),
sl AS (SELECT fire_id, row_number() OVER w - 1 AS slice_index, timestamp, ring_area_km2,
       sum(ring_area_km2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_area_km2,
       sqrt(sum(ring_area_km2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(ring_area_km2) OVER (PARTITION BY fire_id), 0)) AS normalized_vase_width
       FROM g WINDOW w AS (PARTITION BY fire_id ORDER BY timestamp, o_orderkey)),
tr AS (SELECT fire_id, min(year(timestamp)) AS year, sum(ring_area_km2) AS total_area_km2, date_diff('day', min(timestamp), max(timestamp)) + 1 AS duration_days, max(ring_area_km2) AS peak_growth_km2_per_day FROM g GROUP BY 1),
geo AS (SELECT fire_id, year, total_area_km2, CAST(duration_days AS DOUBLE) AS duration_days, peak_growth_km2_per_day, duration_days * 24.0 AS duration_hours, peak_growth_km2_per_day / 24.0 AS peak_growth_km2_per_hour,
        -175.0 + (fire_id * 37) % 120 AS lon, 15.0 + (fire_id * 13) % 50 + 0.25 AS lat FROM tr),
trait AS (SELECT *, CASE WHEN lat >= 50 AND lon BETWEEN -170 AND -130 THEN 'alaska' WHEN lat BETWEEN 18 AND 23 AND lon BETWEEN -161 AND -154 THEN 'hawaii'
          WHEN NOT (lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50) THEN 'outside_conus' WHEN lon < -112 THEN 'west' WHEN lon < -96 THEN 'intermountain' WHEN lon < -84 THEN 'central' ELSE 'east' END AS region FROM geo)"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("area"))
    return population.slices_from_growth(o, "o_custkey", ["day", "o_orderkey"], "day", "area")


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("fire_id"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 1000).alias("area"))
    t = o.groupBy("fire_id").agg(F.min(F.year("day")).cast("long").alias("year"), F.sum("area").alias("total_area_km2"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("double").alias("duration_days"), F.max("area").alias("peak_growth_km2_per_day"))
    t = t.withColumns({"duration_hours": F.col("duration_days") * 24.0, "peak_growth_km2_per_hour": F.col("peak_growth_km2_per_day") / 24.0, "lon": -175.0 + (F.col("fire_id") * 37) % 120, "lat": 15.0 + (F.col("fire_id") * 13) % 50 + 0.25})
    return t.withColumn("region", tables.region(F.col("lon"), F.col("lat")))


def query(name: str, sql: str | None = None, base: str | None = SLICES_SQL):
    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = finished(sql if base is None else f"WITH {base}{sql}")
        return function

    return add


@query("slices", " SELECT fire_id, slice_index, timestamp, round(ring_area_km2, 6) AS ring_area_km2, round(cumulative_area_km2, 6) AS cumulative_area_km2, round(normalized_vase_width, 6) AS normalized_vase_width FROM sl")
def slices_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices(spark, sf_dir)


@query("growth_steps", " SELECT fire_id, slice_index, round(lag(ring_area_km2) OVER w, 6) AS prev_growth, round(lead(ring_area_km2) OVER w, 6) AS next_growth, round(ring_area_km2 - lag(ring_area_km2) OVER w, 6) AS acceleration, round(ln(1 + ring_area_km2), 6) AS log_growth FROM sl WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index)")
def growth_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.growth_steps(slices(spark, sf_dir)).select("fire_id", "slice_index", "prev_growth", "next_growth", "acceleration", "log_growth")


@query("space_time_volume", ", s AS (SELECT *, (cumulative_area_km2 + lag(cumulative_area_km2, 1, 0) OVER w) / 2 * greatest(coalesce(date_diff('day', lag(timestamp) OVER w, timestamp), 1), 1) AS step FROM sl WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index)) SELECT fire_id, slice_index, round(step, 6) AS volume_step, round(sum(step) OVER (PARTITION BY fire_id ORDER BY slice_index ROWS UNBOUNDED PRECEDING), 6) AS volume FROM s")
def space_time_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.space_time_volume(slices(spark, sf_dir)).select("fire_id", "slice_index", "volume_step", "volume")


def _at(values: str, q: float) -> str:
    at = f"({q} * (len({values}) - 1))"
    low = f"CAST(floor({at}) AS INTEGER)"
    return f"({values}[{low} + 1] + ({at} - floor({at})) * ({values}[least({low} + 2, len({values}))] - {values}[{low} + 1]))"


def _features_sql() -> str:
    grid = [i / 10 for i in range(11)]
    profile = ", ".join([f"round({_at('w', g)}, 6) AS width_p{i:02d}" for i, g in enumerate(grid)] + [f"round({_at('fr', g)}, 6) AS growth_p{i:02d}" for i, g in enumerate(grid)])
    return f""", l AS (SELECT fire_id, list(ring_area_km2 ORDER BY slice_index) AS gr, list(cumulative_area_km2 ORDER BY slice_index) AS cu, list(normalized_vase_width ORDER BY slice_index) AS w, count(*) AS n FROM sl GROUP BY 1),
m AS (SELECT l.*, trait.year, trait.region, duration_days, peak_growth_km2_per_day, greatest(total_area_km2, list_max(cu), 1e-9) AS fin FROM l JOIN trait USING (fire_id)),
k AS (SELECT *, list_transform(gr, lambda x: x / fin) AS fr, list_transform(cu, lambda x: x / fin) AS sh, list_sort(gr) AS so,
      CASE WHEN n > 1 THEN list_transform(range(1, n), lambda i: w[i + 1] - w[i]) ELSE [0.0] END AS dw FROM m),
h AS (SELECT *, CASE WHEN len(dw) > 1 THEN list_transform(range(1, len(dw)), lambda i: dw[i + 1] - dw[i]) ELSE [0.0] END AS ddw, greatest({_at('so', 0.75)}, list_max(gr) * 0.25, 1e-9) AS cut FROM k),
p AS (SELECT *, CASE WHEN list_max(gr) > 0 THEN len(list_filter(range(1, n + 1), lambda i: gr[i] >= cut AND (i = 1 OR NOT gr[greatest(i - 1, 1)] >= cut))) ELSE 0 END AS pulses, list_position(gr, list_max(gr)) - 1 AS pk FROM h),
feat AS (SELECT fire_id, CAST(year AS BIGINT) AS year, region, round(fin, 6) AS final_area_km2, duration_days, round(peak_growth_km2_per_day, 6) AS peak_growth_km2_per_day, n AS observation_count, CAST(pulses AS BIGINT) AS pulse_count,
CAST(greatest(pulses - 1, 0) AS BIGINT) AS reactivation_count, round(pk / greatest(n - 1, 1), 6) AS peak_timing, round({_at('sh', 0.5)}, 6) AS front_loaded_fraction,
round(coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN (CASE WHEN n = 1 THEN 0.5 ELSE (i - 1) / (n - 1) END) >= 0.75 THEN fr[i] ELSE 0 END)), 0), 6) AS late_growth_fraction,
round(CASE WHEN list_max(gr) > 0 THEN gr[n] / list_max(gr) ELSE 0 END, 6) AS terminal_taper_fraction, round(-list_sum(list_transform(fr, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(greatest(n, 2)), 6) AS growth_entropy,
round(list_sum(list_transform(dw, lambda x: abs(x))) / len(dw), 6) AS developmental_velocity, round(list_sum(list_transform(ddw, lambda x: abs(x))) / len(ddw), 6) AS developmental_acceleration,
round({_at('w', 0.25)}, 6) AS width_at_quarter, round({_at('w', 0.5)}, 6) AS width_at_half, round({_at('w', 0.75)}, 6) AS width_at_three_quarter, round(duration_days / greatest(2 * sqrt(fin / {math.pi}), 0.1), 6) AS slenderness_days_per_width, {profile} FROM p)"""


FEATURES_SQL = _features_sql()


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traits(spark, sf_dir).select("fire_id", "year", "region", "total_area_km2", "duration_days", "peak_growth_km2_per_day")
    return population.features(slices(spark, sf_dir), t)


@query("fire_features", FEATURES_SQL + " SELECT * FROM feat")
def fire_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)


@query("shape_label", FEATURES_SQL + """, q AS (SELECT quantile_cont(final_area_km2, 0.75) AS a75, quantile_cont(final_area_km2, 0.9) AS a90, quantile_cont(duration_days, 0.5) AS d50, quantile_cont(slenderness_days_per_width, 0.75) AS s75 FROM feat)
SELECT fire_id, CASE WHEN observation_count <= 1 OR duration_days <= 1 THEN 'single flash' WHEN slenderness_days_per_width >= s75 AND final_area_km2 <= a75 THEN 'skinny persistent' WHEN final_area_km2 >= a90 AND duration_days <= d50 THEN 'broad rapid'
WHEN pulse_count >= 3 OR observation_count >= 6 THEN 'multi-pulse complex' WHEN peak_timing >= 0.66 THEN 'late surge' WHEN front_loaded_fraction >= 0.75 AND terminal_taper_fraction <= 0.35 THEN 'front-loaded plateau' ELSE 'compact steady' END AS shape_label FROM feat CROSS JOIN q""")
def shape_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.shape_labels(features(spark, sf_dir)).select("fire_id", "shape_label")


_REL = ", rt AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY fire_id) = 1 THEN 0.5 ELSE (row_number() OVER (PARTITION BY fire_id ORDER BY slice_index) - 1) / greatest(count(*) OVER (PARTITION BY fire_id) - 1, 1) END AS relative_time FROM sl)"


@query("stage_table", _REL + """, s AS (SELECT rt.*, greatest(total_area_km2, 1e-9) AS fin, CASE WHEN relative_time < 0.25 THEN 'early' WHEN relative_time < 0.5 THEN 'expansion' WHEN relative_time < 0.75 THEN 'mature' ELSE 'terminal' END AS stage FROM rt JOIN tr USING (fire_id))
SELECT fire_id, stage, round(sum(ring_area_km2 / fin), 6) AS stage_growth_fraction, round(avg(normalized_vase_width), 6) AS stage_width_mean, round(max(normalized_vase_width) - min(normalized_vase_width), 6) AS stage_width_change, count(*) AS stage_observation_count,
CAST(CASE stage WHEN 'early' THEN 0.125 WHEN 'expansion' THEN 0.375 WHEN 'mature' THEN 0.625 ELSE 0.875 END AS DOUBLE) AS stage_midpoint FROM s GROUP BY fire_id, stage""")
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.stage_table(slices(spark, sf_dir), traits(spark, sf_dir).select("fire_id", F.col("total_area_km2").alias("final_area_km2")))


@query("geometry_events", _REL + """, z AS (SELECT rt.*, max(ring_area_km2) OVER (PARTITION BY fire_id) AS peak, sum(ring_area_km2) OVER (PARTITION BY fire_id) AS fin, count(*) OVER (PARTITION BY fire_id) AS n FROM rt),
y AS (SELECT *, min(CASE WHEN ring_area_km2 = peak THEN slice_index END) OVER (PARTITION BY fire_id) AS pk, ring_area_km2 >= greatest(peak * 0.25, 1e-9) AS act, coalesce(lag(ring_area_km2 >= greatest(peak * 0.25, 1e-9)) OVER (PARTITION BY fire_id ORDER BY slice_index), false) AS before FROM z),
x AS (SELECT *, sum(CASE WHEN act AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY fire_id ORDER BY slice_index) AS burst FROM y),
e AS (SELECT fire_id, 'first_observed_development' AS event_name, 0 AS slice_index FROM x GROUP BY 1
UNION ALL SELECT fire_id, 'emergence_5pct_area', min(slice_index) FROM x WHERE cumulative_area_km2 / fin >= 0.05 GROUP BY 1
UNION ALL SELECT fire_id, 'first_major_burst', min(slice_index) FROM x WHERE act GROUP BY 1
UNION ALL SELECT fire_id, 'peak_expansion', min(pk) FROM x GROUP BY 1
UNION ALL SELECT fire_id, 'final_meaningful_expansion', max(slice_index) FROM x WHERE ring_area_km2 >= greatest(peak * 0.1, fin * 0.01, 1e-9) GROUP BY 1
UNION ALL SELECT fire_id, 'geometric_quiescence', max(n) - 1 FROM x GROUP BY 1
UNION ALL SELECT fire_id, 'slowdown_after_peak', min(slice_index) FROM x WHERE n > 2 AND slice_index > pk AND ring_area_km2 <= peak * 0.25 GROUP BY 1
UNION ALL SELECT fire_id, 'secondary_burst', min(slice_index) FROM x WHERE n > 2 AND burst = 2 AND act AND NOT before GROUP BY 1)
SELECT e.fire_id, e.event_name, CAST(e.slice_index AS BIGINT) AS slice_index, round(rt.relative_time, 6) AS relative_time FROM e JOIN rt ON rt.fire_id = e.fire_id AND rt.slice_index = e.slice_index""")
def geometry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.geometry_events(slices(spark, sf_dir), traits(spark, sf_dir).select("fire_id", F.col("total_area_km2").alias("final_area_km2")))


@query("days_above", " SELECT fire_id, count(CASE WHEN ring_area_km2 >= c THEN 1 END) AS pulse_days FROM sl JOIN (SELECT fire_id, greatest(0.1, 0.25 * max(ring_area_km2), quantile_cont(ring_area_km2, 0.75)) AS c FROM sl GROUP BY 1) USING (fire_id) GROUP BY 1")
def days_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.days_above(slices(spark, sf_dir))


@query("duration_bins", " SELECT CASE WHEN duration_days <= 1 THEN '1' WHEN duration_days <= 3 THEN '2-3' WHEN duration_days <= 7 THEN '4-7' ELSE '8+' END AS bin, count(*) AS n FROM trait GROUP BY 1")
def duration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traits(spark, sf_dir).groupBy(population.duration_bin(F.col("duration_days")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("terciles", " SELECT fire_id, CASE WHEN total_area_km2 <= a THEN 'low' WHEN total_area_km2 <= b THEN 'middle' ELSE 'high' END AS tercile FROM trait CROSS JOIN (SELECT quantile_cont(total_area_km2, 1/3) AS a, quantile_cont(total_area_km2, 2/3) AS b FROM trait)")
def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.terciles(traits(spark, sf_dir), "total_area_km2").select("fire_id", "tercile")


@query("phase_pivot", _REL + " SELECT fire_id, round(avg(CASE WHEN relative_time <= 1/3 THEN ring_area_km2 END), 6) AS early, round(avg(CASE WHEN relative_time > 1/3 AND relative_time <= 2/3 THEN ring_area_km2 END), 6) AS middle, round(avg(CASE WHEN relative_time > 2/3 THEN ring_area_km2 END), 6) AS late FROM rt GROUP BY 1")
def phase_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.phase_pivot(slices(spark, sf_dir), "ring_area_km2")


@query("local_maxima", " SELECT fire_id, slice_index FROM (SELECT *, lag(ring_area_km2) OVER w AS b, lead(ring_area_km2) OVER w AS a FROM sl WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index)) WHERE (b IS NULL OR ring_area_km2 >= b) AND (a IS NULL OR ring_area_km2 >= a)")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.local_maxima(slices(spark, sf_dir), ["fire_id"], "slice_index", "ring_area_km2").select("fire_id", "slice_index")


@query("contrast_pairs", ", e AS (SELECT quantile_cont(total_area_km2, [" + ", ".join(f"{i}/10" for i in range(1, 10)) + "]) AS q FROM trait), b AS (SELECT fire_id, duration_days, len(list_filter(q, lambda x: x <= total_area_km2)) AS bin FROM trait CROSS JOIN e) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, arg_min(fire_id, (duration_days, fire_id)) AS low_id, arg_max(fire_id, (duration_days, fire_id)) AS high_id, round(max(duration_days) - min(duration_days), 6) AS gap FROM b GROUP BY 1 HAVING count(*) >= 5")
def contrast_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.contrast_pairs(traits(spark, sf_dir), "total_area_km2", "duration_days", 10, 5)


@query("stratified_sample", ", r AS (SELECT fire_id, region, row_number() OVER (PARTITION BY region ORDER BY md5(CAST(fire_id AS VARCHAR)), fire_id) AS r FROM trait) SELECT fire_id, region FROM r ORDER BY CASE WHEN r > 5 THEN 1 ELSE 0 END, md5(CAST(fire_id AS VARCHAR)), fire_id LIMIT 40")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.stratified_sample(traits(spark, sf_dir), "region", "fire_id", 5, 40).select("fire_id", "region")


@query("text_search", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '(?i)A.*1') THEN 'p_name' END, CASE WHEN regexp_matches(p_brand, '(?i)A.*1') THEN 'p_brand' END], lambda x: x IS NOT NULL), ',') AS evidence FROM part WHERE regexp_matches(p_name, '(?i)A.*1') OR regexp_matches(p_brand, '(?i)A.*1')", base=None)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = population.text_search(spark.read.parquet(f"{sf_dir}/part.parquet"), "a.*1", "p_partkey", ["p_name", "p_brand"])
    return found.select("p_partkey", F.array_join("evidence", ",").alias("evidence"))


@query("metric_summary", ", l AS (SELECT 'total_area_km2' AS metric, total_area_km2 AS v FROM trait UNION ALL SELECT 'duration_days', duration_days FROM trait) SELECT metric, count(v) AS n, round(min(v), 6) AS min, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM l GROUP BY 1")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.metric_summary(traits(spark, sf_dir), ["total_area_km2", "duration_days"])


@query("region_bucket", ", b AS (SELECT fire_id, region, CAST(floor(lat) AS INTEGER) AS la, CAST(floor(lon) AS INTEGER) AS lo FROM trait) SELECT fire_id, region, concat(CASE WHEN la >= 0 THEN 'n' ELSE 's' END, lpad(CAST(abs(la) AS VARCHAR), 3, '0'), '_', CASE WHEN lo >= 0 THEN 'e' ELSE 'w' END, lpad(CAST(abs(lo) AS VARCHAR), 4, '0')) AS spatial_bucket FROM b")
def region_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traits(spark, sf_dir).select("fire_id", "region", tables.spatial_bucket(F.col("lon"), F.col("lat")).alias("spatial_bucket"))


@query("qc_flags", """, q AS (SELECT o_custkey AS fire_id, count(*) AS seen FROM orders GROUP BY 1), f AS (SELECT fire_id, total_area_km2, seen, seen + fire_id % 3 AS want FROM trait JOIN q USING (fire_id))
SELECT fire_id, CASE WHEN fire_id % 7 = 0 THEN 'empty_geometry' ELSE '' END || CASE WHEN fire_id % 5 = 0 THEN CASE WHEN fire_id % 7 = 0 THEN ',' ELSE '' END || 'invalid_geometry' ELSE '' END AS geometry_flags,
CASE WHEN seen < want AND 1 - seen / want > 0.05 THEN 'tmmx_missing_gt_5pct' WHEN seen < want THEN 'tmmx_missing_le_5pct' ELSE '' END AS climate_flags, NOT (seen < want AND 1 - seen / want > 0.05) AS climate_passed FROM f""")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("fire_id")).agg(F.count(F.lit(1)).alias("seen"))
    f = traits(spark, sf_dir).join(seen, "fire_id").withColumn("want", F.col("seen") + F.col("fire_id") % 3)
    climate = tables.climate_flags(F.col("seen"), F.col("want"), "tmmx")
    geo = tables.geometry_flags(F.col("total_area_km2"), F.col("fire_id") % 5 != 0, F.col("fire_id") % 7 == 0)
    return f.select("fire_id", F.array_join(geo, ",").alias("geometry_flags"), F.array_join(climate, ",").alias("climate_flags"), tables.climate_passed(climate).alias("climate_passed"))


def _allowed_sql() -> str:
    pairs = [(a, b) for a, after in tables.NEXT.items() for b in [*after.split(), *([] if a in ("published", "failed") else ["failed"])]]
    return ", ".join(f"('{a}', '{b}')" for a, b in pairs)


_STATES_SQL = "[" + ", ".join(f"'{s}'" for s in tables.STATES) + "]"


@query("manifest_transition", f""", ok(a, b) AS (VALUES {_allowed_sql()}), m AS (SELECT fire_id, {_STATES_SQL}[fire_id % 10 + 1] AS status, {_STATES_SQL}[(fire_id * 3 + 1) % 10 + 1] AS new_status, fire_id % 4 AS attempts FROM trait)
SELECT m.fire_id, CASE WHEN ok.a IS NOT NULL THEN new_status ELSE status END AS status, attempts + CASE WHEN status = 'pending' AND new_status = 'running' THEN 1 ELSE 0 END AS attempts, ok.a IS NULL AS rejected FROM m LEFT JOIN ok ON ok.a = m.status AND ok.b = m.new_status""")
def manifest_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in tables.STATES])
    t = traits(spark, sf_dir).withColumn("run_id", F.lit("r"))
    manifest = t.select("fire_id", "run_id", F.get(states, (F.col("fire_id") % 10).cast("int")).alias("status"), (F.col("fire_id") % 4).alias("attempts"), F.lit(None).cast("string").alias("failure_reason"))
    requests = t.select("fire_id", "run_id", F.get(states, ((F.col("fire_id") * 3 + 1) % 10).cast("int")).alias("new_status"), F.lit("x").alias("reason"))
    return tables.transitions(manifest, requests).select("fire_id", "status", "attempts", "rejected")


@query("cohort", " SELECT fire_id, region, year FROM trait WHERE region IN ('west', 'east') AND duration_days > 100 AND year = (SELECT min(year) FROM trait)")
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traits(spark, sf_dir)
    first = t.agg(F.min("year").alias("first"))
    return tables.cohort(t.join(F.broadcast(first), t["year"] == first["first"]), region=["west", "east"], duration_days=lambda c: c > 100).select("fire_id", "region", "year")


@query("medoid", ", p AS (SELECT a.region, a.fire_id, sum(sqrt(power(a.total_area_km2 - b.total_area_km2, 2) + power(a.duration_days - b.duration_days, 2))) AS d FROM trait a JOIN trait b USING (region) GROUP BY 1, 2) SELECT region, arg_min(fire_id, (round(d, 9), fire_id)) AS fire_id, round(min(d), 6) AS total_distance FROM p GROUP BY 1")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.medoid(traits(spark, sf_dir), "fire_id", ["total_area_km2", "duration_days"], ["region"])


@query("aligned_quantiles", ", v AS (SELECT slice_index, list(ring_area_km2 ORDER BY ring_area_km2) AS l, median(ring_area_km2) AS m FROM sl GROUP BY 1) SELECT slice_index, CAST(len(l) AS BIGINT) AS count, round(l[CAST(round_even((len(l) - 1) * 0.1, 0) AS INTEGER) + 1], 6) AS q10, round(m, 6) AS q50, round(l[CAST(round_even((len(l) - 1) * 0.9, 0) AS INTEGER) + 1], 6) AS q90 FROM v")
def aligned_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aligned_quantiles(slices(spark, sf_dir), "ring_area_km2", "slice_index")


_SPLIT = ", c AS (SELECT fire_id, bool_and((fire_id + slice_index) % 9 <> 0) AS ok FROM sl GROUP BY 1)"


@query("manifest_split", _SPLIT + " SELECT fire_id, CASE WHEN ok THEN 'complete' WHEN year <> 1995 THEN 'unsupported_year' ELSE 'climate_missing' END AS outcome FROM trait JOIN c USING (fire_id)")
def manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir).withColumn("climate_available", (F.col("fire_id") + F.col("slice_index")) % 9 != 0)
    complete, failed = tables.manifest_split(s, traits(spark, sf_dir), [1995])
    return complete.withColumn("outcome", F.lit("complete")).unionByName(failed.select("fire_id", F.col("failure_reason").alias("outcome")))


@query("cache_keys", """ SELECT fire_id, concat('geometry:', substr(sha256(concat('{"component":"geometry","identity":{"fire_id":"', fire_id, '"},"inputs":{"method":"canonical_fire_time_geometry","source_geometry_hash":"', md5(CAST(fire_id AS VARCHAR)), '"},"versions":{"geometry":"v1"}}')), 1, 24)) AS geometry_cache_key FROM trait""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traits(spark, sf_dir)
    name = F.col("fire_id").cast("string")
    return t.select("fire_id", keys.key_column("geometry", {"fire_id": name}, {"geometry": "v1"}, {"method": "canonical_fire_time_geometry", "source_geometry_hash": F.md5(name)}).alias("geometry_cache_key"))


_D = "duration_hours / 24.0"
_SUMMARIES = {
    "overall": f" SELECT count(*) AS n_fires, CAST(min(year) AS BIGINT) AS min_year, CAST(max(year) AS BIGINT) AS max_year, count(DISTINCT year) AS n_years, round(sum(total_area_km2), 6) AS total_area_km2, round(avg(total_area_km2), 6) AS mean_area_km2, round(median(total_area_km2), 6) AS median_area_km2, round(max(total_area_km2), 6) AS max_area_km2, round(avg({_D}), 6) AS mean_duration_days, round(median({_D}), 6) AS median_duration_days, round(max({_D}), 6) AS max_duration_days FROM trait",
    "by_year": " SELECT CAST(year AS BIGINT) AS year, count(*) AS n, round(avg(total_area_km2), 6) AS mean_area_km2, round(sum(total_area_km2), 6) AS total_area_km2 FROM trait GROUP BY 1",
    "by_region": f" SELECT region, count(*) AS n, round(avg(total_area_km2), 6) AS mean_area_km2, round(median(total_area_km2), 6) AS median_area_km2, round(sum(total_area_km2), 6) AS total_area_km2, round(avg({_D}), 6) AS mean_duration_days FROM trait GROUP BY 1",
    "by_region_year": " SELECT region, CAST(year AS BIGINT) AS year, count(*) AS n FROM trait GROUP BY 1, 2",
    "largest": f" SELECT fire_id, region, CAST(year AS BIGINT) AS year, round(total_area_km2, 6) AS total_area_km2, round({_D}, 6) AS duration_days, round(peak_growth_km2_per_hour * 24.0, 6) AS peak_growth_km2_per_day FROM trait ORDER BY trait.total_area_km2 DESC, fire_id LIMIT 20",
    "duration_top": f" SELECT fire_id, region, CAST(year AS BIGINT) AS year, round(total_area_km2, 6) AS total_area_km2, round({_D}, 6) AS duration_days FROM trait ORDER BY duration_hours DESC, fire_id LIMIT 20",
    "quantiles": " SELECT " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}_p{int(p * 100):02d}" for c, n in (("total_area_km2", "area"), (_D, "duration")) for p in (0.01, 0.1, 0.5, 0.9, 0.99)) + " FROM trait",
    "sample": f" SELECT fire_id, region, CAST(year AS BIGINT) AS year, round(total_area_km2, 6) AS total_area_km2, round({_D}, 6) AS duration_days FROM trait ORDER BY md5(CAST(fire_id AS VARCHAR)), fire_id LIMIT 12000",
}
for _name, _sql in _SUMMARIES.items():
    query(f"population_{_name}", _sql)(lambda spark, sf_dir, name=_name: tables.population_summaries(traits(spark, sf_dir))[name])


# Volumes and polygons.

_HOT = cube_sql(None) + ", hot AS (SELECT time, y, x, t_idx, y_idx, x_idx, (t_idx * (SELECT max(y_idx) + 1 FROM cube) + y_idx) * (SELECT max(x_idx) + 1 FROM cube) + x_idx AS cell FROM cube WHERE value >= 70)"
_TUBES = _HOT + """, near AS (SELECT a.cell AS u, b.cell AS v FROM hot a JOIN hot b ON abs(a.t_idx - b.t_idx) + abs(a.y_idx - b.y_idx) + abs(a.x_idx - b.x_idx) = 1),
walk AS (WITH RECURSIVE r AS (SELECT cell AS root, cell FROM hot UNION SELECT r.root, near.v FROM r JOIN near ON near.u = r.cell WHERE near.v > -1) SELECT cell, min(root) AS label FROM r GROUP BY 1),
tb AS (SELECT hot.*, dense_rank() OVER (ORDER BY label) AS tube_id FROM hot JOIN walk USING (cell))"""


def _tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = reduce.mask_by_threshold(demo_cube(spark, sf_dir, None), 70.0, ">=")
    return tubes.label_tubes(mask, 6)


@query("tube_label", _TUBES + " SELECT time, y, x, tube_id FROM tb", base="")
def tube_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tubes(spark, sf_dir).select("time", "y", "x", "tube_id")


@query("tube_metrics", _TUBES + ", k AS (SELECT tube_id, time, count(*) AS c, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM tb GROUP BY 1, 2) SELECT tube_id, count(*) AS duration_steps, CAST(sum(c) AS BIGINT) AS n_voxels, min(time) AS time_start, max(time) AS time_end, min(y0) AS y_min, max(y1) AS y_max, min(x0) AS x_min, max(x1) AS x_max, round(avg(c), 6) AS cells_per_timestep_mean, max(c) AS cells_per_timestep_max FROM k GROUP BY 1", base="")
def tube_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.tube_metrics(_tubes(spark, sf_dir))


_TRIANGLE = [(0.0, 0.0), (9.0, 1.0), (4.0, 4.0)]


def _inside_triangle(points: list[tuple[float, float]], shift: str) -> str:
    sides = []
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        sides.append(f"({bx - ax}) * (y - ({ay})) - ({by - ay}) * (x - ({ax} + {shift})) >= -1e-12")
    return " AND ".join(sides)


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle that moves by two columns between the first and the last day."""
    days = demo_cube(spark, sf_dir, None).times().agg(F.min("time").alias("a"), F.max("time").alias("b"))
    ring = lambda d: F.array(*[F.struct(F.lit(x + d).alias("x"), F.lit(y).alias("y")) for x, y in _TRIANGLE])
    return days.select(F.explode(F.array(F.struct(F.col("a").alias("time"), ring(0.0).alias("ring")), F.struct(F.col("b").alias("time"), ring(2.0).alias("ring")))).alias("p")).select("p.*")


@query("vase_mask", cube_sql(None) + f", n AS (SELECT max(t_idx) AS n FROM cube) SELECT time, y, x, CASE WHEN t_idx <= n - t_idx THEN {_inside_triangle(_TRIANGLE, '0')} ELSE {_inside_triangle(_TRIANGLE, '2')} END AS mask FROM cube CROSS JOIN n", base="")
def vase_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.vase_mask(demo_cube(spark, sf_dir, None), _triangles(spark, sf_dir)).df.select("time", "y", "x", "mask")


@query("vase_points_linear", cube_sql(None) + f", n AS (SELECT max(t_idx) AS n FROM cube) SELECT time, y, x, round(value, 6) AS value FROM cube CROSS JOIN n WHERE value IS NOT NULL AND ({_inside_triangle(_TRIANGLE, '2 * t_idx / n')})", base="")
def vase_points_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.vase_points(demo_cube(spark, sf_dir, None), _triangles(spark, sf_dir), "linear")


@query("hull_metrics", cube_sql(None) + """, tn AS (SELECT time, t_idx, (SELECT max(t_idx) + 1 FROM cube) AS n FROM (SELECT DISTINCT time, t_idx FROM cube)), hv AS (SELECT time, t_idx, 3.0 * (1 - t_idx / (2.0 * n)) AS h FROM tn),
a AS (SELECT time, h, 4 * h * h AS area, (4 * h * h + lag(4 * h * h) OVER (ORDER BY time)) / 2 * date_diff('day', lag(time) OVER (ORDER BY time), time) AS slab FROM hv), u AS (SELECT avg(abs(cos(2 * pi() * k / 96)) + abs(sin(2 * pi() * k / 96))) AS m, max(abs(cos(2 * pi() * k / 96)) + abs(sin(2 * pi() * k / 96))) AS t FROM (SELECT unnest(range(0, 96)) AS k))
SELECT 1 AS event_id, count(*) AS n_days, round(max(area), 6) AS peak_area, round(arg_max(area, time), 6) AS final_area, round(sum(coalesce(slab, 0)), 6) AS volume, round(avg(h * m), 6) AS mean_radius, round(max(h * t), 6) AS max_radius FROM a CROSS JOIN u""", base="")
def hull_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = [r["time"] for r in demo_cube(spark, sf_dir, None).times().orderBy("t_idx").select("time").collect()]
    vase = demo_vase(spark, days).withColumn("event_id", F.lit(1))
    return geometry.hull_metrics(vase, ["event_id"])


# Exposure.


@query("group_anomaly", ", m AS (SELECT *, month(timestamp) AS mo, fire_id % 4 AS reg FROM sl) SELECT fire_id, slice_index, round(median(ring_area_km2) OVER (PARTITION BY reg, mo), 6) AS ring_area_km2_median, round(ring_area_km2 - median(ring_area_km2) OVER (PARTITION BY reg, mo), 6) AS ring_area_km2_anomaly FROM m")
def group_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir).withColumns({"mo": F.month("timestamp"), "reg": F.col("fire_id") % 4})
    return exposure.group_anomaly(s, ["reg", "mo"], "ring_area_km2").select("fire_id", "slice_index", "ring_area_km2_median", "ring_area_km2_anomaly")


@query("extreme_flags", " SELECT fire_id, total_area_km2 >= (SELECT quantile_cont(total_area_km2, 0.9) FROM trait) AS total_area_km2_high, duration_days <= (SELECT quantile_cont(duration_days, 0.1) FROM trait) AS duration_days_low FROM trait")
def extreme_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.extreme_flags(traits(spark, sf_dir), ["total_area_km2"], ["duration_days"]).select("fire_id", "total_area_km2_high", "duration_days_low")


@query("terminal_features", """, t AS (SELECT fire_id, ring_area_km2 AS v, row_number() OVER (PARTITION BY fire_id ORDER BY slice_index DESC) AS b, avg(ring_area_km2) OVER p AS m, stddev_pop(ring_area_km2) OVER p AS s, count(*) OVER p AS n,
rank() OVER (PARTITION BY fire_id ORDER BY ring_area_km2) + (count(*) OVER (PARTITION BY fire_id, ring_area_km2) - 1) / 2.0 AS r FROM sl WINDOW p AS (PARTITION BY fire_id))
SELECT fire_id, round(CASE WHEN any_value(n) > 1 THEN regr_slope(v, -b) FILTER (b <= 3) END, 6) AS terminal_slope, round(max(v) FILTER (b = 1), 6) AS terminal_value, round(max((v - m) / s) FILTER (b = 1 AND s > 0), 6) AS terminal_z, round(max(r / n) FILTER (b = 1), 6) AS terminal_rank FROM t GROUP BY 1""")
def terminal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.terminal_features(slices(spark, sf_dir), ["fire_id"], "slice_index", "ring_area_km2")


@query("effect_table", ", r AS (SELECT rank() OVER (ORDER BY duration_days) + (count(*) OVER (PARTITION BY duration_days) - 1) / 2.0 AS a, rank() OVER (ORDER BY total_area_km2) + (count(*) OVER (PARTITION BY total_area_km2) - 1) / 2.0 AS b FROM trait) SELECT 'duration_days' AS predictor, 'total_area_km2' AS response, count(*) AS n, CASE WHEN count(*) >= 100 THEN round(corr(a, b), 6) END AS rho FROM r")
def effect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.effect_table(traits(spark, sf_dir), ["duration_days"], ["total_area_km2"])


_BURNED = "b AS (SELECT user_id % 3 AS event_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day, user_id % 5 AS y, CAST(floor(user_id / 5) AS BIGINT) AS x FROM events WHERE event_type = 'error'), f AS (SELECT event_id, y, x, min(day) AS reached FROM b GROUP BY 1, 2, 3), gr AS (SELECT DISTINCT user_id % 5 AS y, CAST(floor(user_id / 5) AS BIGINT) AS x FROM events), d AS (SELECT DISTINCT event_id, day FROM b WHERE day % 10 = 0)"


#: The zones of every tenth day; as a check of those days only, no oracle of the query, which reports every day.
EXPOSURE_TENTH_SQL = finished(f"""WITH {_BURNED}, z AS (SELECT d.event_id, d.day, gr.y, gr.x, (SELECT reached FROM f WHERE f.event_id = d.event_id AND f.y = gr.y AND f.x = gr.x) AS reached, min(n.reached) AS near FROM d CROSS JOIN gr JOIN f n ON n.event_id = d.event_id AND abs(n.y - gr.y) <= 1 AND abs(n.x - gr.x) <= 1 GROUP BY 1, 2, 3, 4),
u AS (SELECT event_id, day, 'active' AS zone FROM z WHERE reached = day UNION ALL SELECT event_id, day, 'cumulative' FROM z WHERE reached <= day UNION ALL SELECT event_id, day, 'extension' FROM z WHERE near <= day AND (reached IS NULL OR reached > day)) SELECT event_id, day, zone, count(*) AS n_cells FROM u GROUP BY 1, 2, 3""")


@query("exposure_zones")
def exposure_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.datediff("ts", F.lit("2024-01-01")).alias("day"), (F.col("user_id") % 3).alias("event_id"), (F.col("user_id") % 5).alias("y"), F.floor(F.col("user_id") / 5).alias("x"))
    burned = e.where("event_type = 'error'").drop("event_type")
    days = burned.select("event_id", "day").distinct()
    return exposure.exposure_zones(burned, e.select("y", "x").distinct(), days, 1).groupBy("event_id", "day", "zone").agg(F.count(F.lit(1)).alias("n_cells"))


@query("zone_summary", cube_sql(None) + " SELECT y_idx // 2 AS zone, time, round(avg(value), 6) AS value_mean, round(min(value), 6) AS value_minimum, round(max(value), 6) AS value_maximum, round(stddev_pop(value), 6) AS value_std, count(value) AS sample_cell_count FROM cube GROUP BY 1, 2", base="")
def zone_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = demo_cube(spark, sf_dir, None).df.withColumn("zone", F.floor(F.col("y_idx") / 2).cast("int"))
    return exposure.zone_summary(cells, ["zone", "time"], "value")


@query("environmental_roles", cube_sql(None) + ", p AS (SELECT *, lag(value) OVER (PARTITION BY y, x ORDER BY t_idx) AS b FROM cube), s AS (SELECT y, x, CAST(count(value + b) AS DOUBLE) AS n, stddev_pop(value) AS sd, stddev_pop(value - b) AS st, avg(value) FILTER (b IS NOT NULL) AS ma, avg(b) FILTER (value IS NOT NULL) AS mb, avg(value * b) AS mab, avg(value * value) FILTER (b IS NOT NULL) AS maa, avg(b * b) FILTER (value IS NOT NULL) AS mbb FROM p GROUP BY 1, 2) SELECT y, x, round(sd, 6) AS sd, round(st, 6) AS sd_of_steps, CASE WHEN n >= 2 AND maa - ma * ma > 1e-12 * greatest(maa, 1) AND mbb - mb * mb > 1e-12 * greatest(mbb, 1) THEN round(greatest(-1, least(1, (mab - ma * mb) / sqrt((maa - ma * ma) * (mbb - mb * mb)))), 6) END AS lag1 FROM s", base="")
def environmental_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposure.environmental_roles(demo_cube(spark, sf_dir, None).df, ["y", "x"], "t_idx", "value")


@query("interpolate_profiles", ", l AS (SELECT fire_id, list(normalized_vase_width ORDER BY slice_index) AS w FROM sl GROUP BY 1) " + " UNION ALL ".join(f"SELECT fire_id, CAST({g} AS DOUBLE) AS grid, round(CASE WHEN len(w) = 1 THEN w[1] ELSE {_at('w', g)} END, 6) AS value FROM l" for g in (0.0, 0.3, 0.5, 1.0)))
def interpolate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = population.relative_time(slices(spark, sf_dir))
    return align.interpolate_grid(s, ["fire_id"], [0.0, 0.3, 0.5, 1.0], "relative_time", "normalized_vase_width").withColumnRenamed("normalized_vase_width", "value")


@query("growth_derivative", " SELECT fire_id, slice_index, round(CASE WHEN lag(cumulative_area_km2) OVER w IS NULL THEN lead(cumulative_area_km2) OVER w - cumulative_area_km2 WHEN lead(cumulative_area_km2) OVER w IS NULL THEN cumulative_area_km2 - lag(cumulative_area_km2) OVER w ELSE (lead(cumulative_area_km2) OVER w - lag(cumulative_area_km2) OVER w) / 2 END, 6) AS d_cumulative_area_km2 FROM sl WINDOW w AS (PARTITION BY fire_id ORDER BY slice_index)")
def growth_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.derivative(slices(spark, sf_dir), ["fire_id"], "slice_index", "cumulative_area_km2").select("fire_id", "slice_index", "d_cumulative_area_km2")


@query("label_purity", """WITH e AS (SELECT vec_id, embedding, label FROM embeddings), d AS (SELECT a.vec_id AS q, a.label AS l, b.vec_id AS v, b.label AS m, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d2, 9), v) AS k FROM d) SELECT l AS label, round(avg(CASE WHEN l = m THEN 1.0 ELSE 0.0 END), 6) AS purity, count(*) AS n FROM r WHERE k <= 15 GROUP BY 1""", base=None)
def label_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return models.label_purity(models.knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 15), e, "vec_id", "label")


# Models.

_COLS = ["total_area_km2", "duration_days", "peak_growth_km2_per_day"]


def _standard_sql(center: str) -> str:
    return ", ".join(f"({c} - (SELECT {center}({c}) FROM trait)) / (SELECT stddev_pop({c}) FROM trait) AS {c}" for c in _COLS)


@query("standardised", f" SELECT fire_id, {', '.join(f'round({c}, 6) AS {c}' for c in _COLS)} FROM (SELECT fire_id, {_standard_sql('median')} FROM trait)")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.standardised(traits(spark, sf_dir), _COLS).select("fire_id", *_COLS)


@query("gram_matrix", f", z AS (SELECT {_standard_sql('median')} FROM trait) " + " UNION ALL ".join(f"SELECT '{_COLS[i]}' AS i, '{_COLS[j]}' AS j, round(sum({_COLS[i]} * {_COLS[j]}), 6) AS value FROM z" for i in range(3) for j in range(i, 3)))
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.gram(models.standardised(traits(spark, sf_dir), _COLS), _COLS)


@query("bootstrap_pca")
def bootstrap_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.bootstrap_pca(traits(spark, sf_dir), _COLS, "fire_id", 20, 2)


@query("blocked_cv_ols", """, d AS (SELECT region, duration_days AS p, total_area_km2 AS q FROM trait), s AS (SELECT region, count(*) AS n, sum(p) AS sp, sum(q) AS sq, sum(p * p) AS spp, sum(p * q) AS spq, sum(q * q) AS sqq FROM d GROUP BY 1),
t AS (SELECT s.*, (SELECT sum(n) FROM s) - n AS tn, (SELECT sum(sp) FROM s) - sp AS tp, (SELECT sum(sq) FROM s) - sq AS tq, (SELECT sum(spp) FROM s) - spp AS tpp, (SELECT sum(spq) FROM s) - spq AS tpq FROM s),
b AS (SELECT *, (tn * tpq - tp * tq) / (tn * tpp - tp * tp) AS slope FROM t), c AS (SELECT *, (tq - slope * tp) / tn AS icept FROM b)
SELECT region AS block, n, CASE WHEN n > 1 AND sqq - sq * sq / n > 1e-9 * sqq THEN round(1 - (sqq - 2 * (icept * sq + slope * spq) + icept * icept * n + 2 * icept * slope * sp + slope * slope * spp) / (sqq - sq * sq / n), 6) END AS r2 FROM c""")
def blocked_cv_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.blocked_cv(traits(spark, sf_dir), ["duration_days"], "total_area_km2", "region")


@query("knn_match", """WITH e AS (SELECT vec_id, embedding FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)) AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d2, 9), neighbor_id) AS INTEGER) AS rank FROM d) SELECT query_id, rank, neighbor_id, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= 5""", base=None)
def knn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return models.knn(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)


@query("ward_clusters")
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.ward_clusters(models.standardised(traits(spark, sf_dir), _COLS), "fire_id", _COLS, 4)
