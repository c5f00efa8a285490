"""Registered queries over cubes, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import percent_rank_average
from .operators import align, blocks, events, reduce, rolling, states, synchrony
from .oracles import finished, rounded
from .plans.cube import PIXEL, Cube, merge
from .plans.pipe import apply, pipe
from .sources import aoi
from .sources.cubes import band_cube_cells, demo_cells, demo_cube

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def cube_sql(event_type: str | None = "view", name: str = "cube") -> str:
    """The demo cube as SQL, named ``name``."""
    where = f"WHERE event_type = '{event_type}'" if event_type else ""
    n = name
    return f"""
{n}_raw AS (
    SELECT CAST(ts AS DATE) AS time, user_id % 5 AS y, CAST(floor(user_id / 5) AS BIGINT) AS x, avg(value) AS value
    FROM events {where} GROUP BY 1, 2, 3
), {n}_t AS (
    SELECT time, CAST(row_number() OVER (ORDER BY time) - 1 AS INTEGER) AS t_idx FROM (SELECT DISTINCT time FROM {n}_raw)
), {n}_p AS (
    SELECT y, x, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS y_idx, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INTEGER) AS x_idx
    FROM (SELECT DISTINCT y, x FROM {n}_raw)
), {n} AS (
    SELECT t.time, t.t_idx, p.y, p.x, p.y_idx, p.x_idx, r.value
    FROM {n}_p p CROSS JOIN {n}_t t LEFT JOIN {n}_raw r ON r.time = t.time AND r.y = p.y AND r.x = p.x
)"""


def query(name: str, sql: str | None = None, **cubes: str | None):
    """Register a query; ``sql`` may use the named demo cubes (``cube`` of all events if none is named)."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            used = cubes or {"cube": None}
            ORACLES[name] = finished("WITH " + ",".join(cube_sql(v, k) for k, v in used.items()) + sql)
        return function

    return add


def _cube(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> Cube:
    return demo_cube(spark, sf_dir, event_type)


def _simple(name: str, verb, columns: str, sql: str) -> None:
    """A query that pipes the demo cube through one verb."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = (pipe(_cube(spark, sf_dir)) | verb).unwrap()
        return rounded((out.df if isinstance(out, Cube) else out).select(*columns.split()))

    query(name, sql)(run)


_simple("cube_mean_time", reduce.mean(dim="time"), "y x value", " SELECT y, x, round(avg(value), 6) AS value FROM cube GROUP BY y, x")
_simple("cube_mean_space", reduce.mean(dim="space"), "time value", " SELECT time, round(avg(value), 6) AS value FROM cube GROUP BY time")
_simple("cube_mean_strict", reduce.mean(dim="time", skipna=False), "y x value", " SELECT y, x, CASE WHEN count(value) = count(*) THEN round(avg(value), 6) END AS value FROM cube GROUP BY y, x")
_simple("cube_mean_keepdim", reduce.mean(dim="time", keep_dim=True), "time t_idx y x value", " SELECT CAST(NULL AS DATE) AS time, CAST(0 AS INTEGER) AS t_idx, y, x, round(avg(value), 6) AS value FROM cube GROUP BY y, x")
_simple("cube_variance_time", reduce.variance(dim="time"), "y x value", " SELECT y, x, round(var_pop(value), 6) AS value FROM cube GROUP BY y, x")
_simple("cube_variance_space", reduce.variance(dim="space"), "time value", " SELECT time, round(var_pop(value), 6) AS value FROM cube GROUP BY time")
_simple("cube_mean_y", reduce.mean(dim="y"), "time x value", " SELECT time, x, round(avg(value), 6) AS value FROM cube GROUP BY time, x")
_simple("cube_median_space", reduce.median(dim="space"), "time value", " SELECT time, round(median(value), 6) AS value FROM cube GROUP BY time")
_simple("cube_anomaly", reduce.anomaly(), "time y x value", " SELECT time, y, x, round(value - avg(value) OVER (PARTITION BY y, x), 6) AS value FROM cube")
_simple("cube_anomaly_space", reduce.anomaly(dim="space"), "time y x value", " SELECT time, y, x, round(value - avg(value) OVER (PARTITION BY time), 6) AS value FROM cube")
_simple(
    "cube_zscore", reduce.zscore(), "time y x value_zscore",
    " SELECT time, y, x, round(CASE WHEN sd > 1e-4 THEN (value - m) / sd END, 6) AS value_zscore FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM cube WINDOW w AS (PARTITION BY y, x))",
)
_simple(
    "temporal_anomaly", reduce.temporal_anomaly("2024-01-01", "2024-01-10"), "time y x value",
    " SELECT time, y, x, round(value - avg(CASE WHEN time BETWEEN DATE '2024-01-01' AND DATE '2024-01-10' THEN value END) OVER (PARTITION BY y, x), 6) AS value FROM cube",
)
_simple("temporal_difference", reduce.temporal_difference(2), "time y x value", " SELECT time, y, x, round(value - lag(value, 2) OVER (PARTITION BY y, x ORDER BY t_idx), 6) AS value FROM cube")
_simple(
    "rolling_mean", reduce.rolling_mean(5, 3), "time y x value",
    " SELECT time, y, x, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS value FROM cube WINDOW w AS (PARTITION BY y, x ORDER BY t_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
)
_simple(
    "rolling_mean_centered", reduce.rolling_mean(4, 2, center=True), "time y x value",
    " SELECT time, y, x, CASE WHEN count(value) OVER w >= 2 THEN round(avg(value) OVER w, 6) END AS value FROM cube WINDOW w AS (PARTITION BY y, x ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
)
_simple(
    "running_stats", reduce.running_stats(), "time y x n_so_far sum_so_far max_so_far mean_so_far active_so_far is_min_so_far",
    """ SELECT time, y, x, count(value) OVER w AS n_so_far, round(sum(value) OVER w, 6) AS sum_so_far, round(max(value) OVER w, 6) AS max_so_far,
    round(avg(value) OVER w, 6) AS mean_so_far, count(CASE WHEN value > 0 THEN 1 END) OVER w AS active_so_far, coalesce(value <= min(value) OVER w, false) AS is_min_so_far
    FROM cube WINDOW w AS (PARTITION BY y, x ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
_simple("month_filter", reduce.month_filter([1, 3]), "time y x value", " SELECT time, y, x, round(value, 6) AS value FROM cube WHERE month(time) IN (1, 3)")
_simple("threshold_mask", reduce.mask_by_threshold(40.0, ">="), "time y x mask", " SELECT time, y, x, coalesce(value >= 40, false) AS mask FROM cube")
_simple("suitability", reduce.suitability(20.0, 60.0), "time y x suitable", " SELECT time, y, x, coalesce(value BETWEEN 20 AND 60, false) AS suitable FROM cube")
_simple("time_stride", reduce.time_stride(4), "time y x value", " SELECT time, y, x, round(value, 6) AS value FROM cube WHERE t_idx % 4 = 0")
_simple("flatten_space", reduce.flatten_space(), "time pixel value", " SELECT time, CAST(y_idx AS BIGINT) * (SELECT max(x_idx) + 1 FROM cube) + x_idx AS pixel, round(value, 6) AS value FROM cube")
_simple("where_mask", apply(lambda c: reduce.where_mask(c, F.col("x") % 2 == 0)), "time y x value", " SELECT time, y, x, CASE WHEN x % 2 = 0 THEN round(value, 6) END AS value FROM cube")
_simple(
    "coarsen_mean", reduce.coarsen_mean(2, 2), "time by bx y x value",
    """ SELECT time, y_idx // 2 AS by, x_idx // 2 AS bx, round(avg(y), 6) AS y, round(avg(x), 6) AS x, round(avg(value), 6) AS value
    FROM cube WHERE y_idx < (SELECT max(y_idx) + 1 - (max(y_idx) + 1) % 2 FROM cube) AND x_idx < (SELECT max(x_idx) + 1 - (max(x_idx) + 1) % 2 FROM cube) GROUP BY 1, 2, 3""",
)
_simple(
    "smooth_mean", reduce.smooth_mean(3), "time y x value_smooth",
    """ SELECT a.time, a.y, a.x, CASE WHEN count(b.value) = 9 THEN round(avg(b.value), 6) END AS value_smooth
    FROM cube a LEFT JOIN cube b ON a.t_idx = b.t_idx AND abs(a.y_idx - b.y_idx) <= 1 AND abs(a.x_idx - b.x_idx) <= 1 GROUP BY 1, 2, 3""",
)
_simple("resample_weekly", reduce.resample_mean("week"), "time y x value", " SELECT CAST(date_trunc('week', time) AS DATE) AS time, y, x, round(avg(value), 6) AS value FROM cube GROUP BY 1, 2, 3")
_simple(
    "percent_rank_average", apply(lambda c: c.df.where("value is not null").select("time", "y", "x", percent_rank_average(F.col("value"), [F.col("y"), F.col("x")]).alias("pct"))), "time y x pct",
    " SELECT time, y, x, round((rank() OVER (PARTITION BY y, x ORDER BY value) + (count(*) OVER (PARTITION BY y, x, value) - 1) / 2.0) / count(*) OVER (PARTITION BY y, x), 6) AS pct FROM cube WHERE value IS NOT NULL",
)


@query("zscore_mean_pipe", " SELECT time, round(avg(z), 6) AS value_zscore FROM (SELECT time, CASE WHEN stddev_pop(value) OVER w > 1e-4 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM cube WINDOW w AS (PARTITION BY y, x)) GROUP BY time")
def zscore_mean_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded((pipe(_cube(spark, sf_dir)) | reduce.zscore() | reduce.mean(dim="space")).unwrap().select("time", "value_zscore"))


@query("anomaly_against", " SELECT a.time, a.y, a.x, round(a.value - b.m, 6) AS value FROM a LEFT JOIN (SELECT y, x, avg(value) AS m FROM b GROUP BY y, x) b ON a.y = b.y AND a.x = b.x", a="view", b="click")
def anomaly_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reduce.anomaly_against(_cube(spark, sf_dir, "view"), _cube(spark, sf_dir, "click")).df.select("time", "y", "x", "value"))


@query("aoi_crop", " SELECT time, y, x, round(value, 6) AS value FROM cube_raw WHERE x BETWEEN 1 AND 8 AND y BETWEEN 0 AND 2")
def aoi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aoi.crop(demo_cells(spark, sf_dir, None), aoi.area(bbox=(1, 0, 8, 2))).select("time", "y", "x", "value"))


@query("lon_wrap", " SELECT DISTINCT x FROM cube_raw WHERE (x * 20) % 360 >= 340 OR (x * 20) % 360 <= 40")
def lon_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = demo_cells(spark, sf_dir, None).withColumns({"lon": (F.col("x") * 20) % 360, "lat": F.lit(0.0)})
    return cells.where(aoi.inside(aoi.Box(-20, -10, 40, 10), "lon", "lat", wrapped=True)).select("x").distinct()


NDVI_SQL = " SELECT a.time, a.y, a.x, round((a.value - b.value) / nullif(a.value + b.value, 0), 6) AS ndvi FROM a JOIN b ON a.time = b.time AND a.y = b.y AND a.x = b.x"


@query("ndvi", NDVI_SQL, a="view", b="click")
def ndvi(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = merge(_cube(spark, sf_dir, "view").with_values(nir=F.col("value")), _cube(spark, sf_dir, "click").with_values(red=F.col("value")))
    return rounded(both.df.select("time", "y", "x", reduce.ndvi(F.col("nir"), F.col("red")).alias("ndvi")))


@query("band_pivot", " SELECT time, y, x, round(max(CASE WHEN band = 'view' THEN value END), 6) AS view, round(max(CASE WHEN band = 'click' THEN value END), 6) AS click FROM (SELECT CAST(ts AS DATE) AS time, user_id % 5 AS y, CAST(floor(user_id / 5) AS BIGINT) AS x, event_type AS band, avg(value) AS value FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def band_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = band_cube_cells(spark, sf_dir, ["view", "click"])
    return rounded(cells.groupBy("time", "y", "x").pivot("band", ["view", "click"]).agg(F.first("value")))


for _how, _agg in (("sum", "sum(v)"), ("mean", "avg(v)"), ("count", "CAST(nullif(count(v), 0) AS DOUBLE)")):
    _RASTER = f"""
, o AS (SELECT CAST(ts AS DATE) AS time, (user_id * 7) % 6 - 0.4 AS py, (user_id * 3) % 40 + 0.3 AS px, value AS v FROM events WHERE event_type = 'purchase'),
s AS (SELECT o.time, o.v, (SELECT arg_min(y, (abs(y - py), y)) FROM (SELECT DISTINCT y FROM cube)) AS y, (SELECT arg_min(x, (abs(x - px), x)) FROM (SELECT DISTINCT x FROM cube)) AS x FROM o)
SELECT c.time, c.y, c.x, round({_agg}, 6) AS value FROM cube c LEFT JOIN s ON s.time = c.time AND s.y = c.y AND s.x = c.x GROUP BY 1, 2, 3"""

    def _rasterize(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        o = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
        points = o.select(F.to_date("ts").alias("time"), ((F.col("user_id") * 7) % 6 - 0.4).alias("y"), ((F.col("user_id") * 3) % 40 + 0.3).alias("x"), "value")
        return rounded(reduce.rasterize(points, _cube(spark, sf_dir), how))

    query(f"rasterize_{_how}", _RASTER)(_rasterize)


_PEARSON = "CASE WHEN n >= 2 AND vx > 1e-12 * greatest(sxx / n, 1) AND vy > 1e-12 * greatest(syy / n, 1) THEN greatest(-1, least(1, (sxy / n - (sx / n) * (sy / n)) / sqrt(vx * vy))) END"
_CENTER = "ctr AS (SELECT t_idx, value AS center FROM cube WHERE y_idx = (SELECT (max(y_idx) + 1) // 2 FROM cube) AND x_idx = (SELECT (max(x_idx) + 1) // 2 FROM cube))"


@query("rolling_corr_center", f"""
, {_CENTER}, j AS (SELECT c.*, ctr.center, CASE WHEN c.value IS NOT NULL AND center IS NOT NULL THEN c.value END AS a, CASE WHEN c.value IS NOT NULL AND center IS NOT NULL THEN center END AS b FROM cube c JOIN ctr ON c.t_idx = ctr.t_idx),
s AS (SELECT time, y, x, count(*) OVER w AS k, CAST(nullif(count(a) OVER w, 0) AS DOUBLE) AS n, sum(a) OVER w AS sx, sum(b) OVER w AS sy, sum(a * a) OVER w AS sxx, sum(b * b) OVER w AS syy, sum(a * b) OVER w AS sxy
      FROM j WINDOW w AS (PARTITION BY y, x ORDER BY time RANGE BETWEEN INTERVAL 10 DAYS PRECEDING AND CURRENT ROW)),
v AS (SELECT *, sxx / n - (sx / n) * (sx / n) AS vx, syy / n - (sy / n) * (sy / n) AS vy FROM s)
SELECT time, y, x, CASE WHEN k >= 5 THEN round({_PEARSON}, 6) END AS corr FROM v""")
def rolling_corr_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded((pipe(_cube(spark, sf_dir)) | rolling.rolling_corr_vs_center(10, 5)).unwrap())


@query("tail_variance_contrast", """
, w AS (SELECT a.time, a.y, a.x, b.value AS v FROM cube a JOIN cube b ON a.y = b.y AND a.x = b.x AND b.t_idx BETWEEN a.t_idx - 9 AND a.t_idx),
q AS (SELECT time, y, x, count(v) AS n, var_pop(v) AS everything, quantile_cont(v, 0.8) AS cut FROM w GROUP BY 1, 2, 3)
SELECT q.time, q.y, q.x, CASE WHEN q.n >= 3 AND count(CASE WHEN w.v >= q.cut THEN 1 END) > 0 THEN round(var_pop(CASE WHEN w.v >= q.cut THEN w.v END) - any_value(q.everything), 6) END AS contrast
FROM q LEFT JOIN w ON q.time = w.time AND q.y = w.y AND q.x = w.x GROUP BY q.time, q.y, q.x, q.n""")
def tail_variance_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded((pipe(_cube(spark, sf_dir)) | rolling.rolling_tail_contrast(10, 0.8, 3)).unwrap())


def _rank_sql(c: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"


def _pearson_sql(source: str, keys: str, a: str, b: str, extra: str = "") -> str:
    sums = f"SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, sum({a}) AS sx, sum({b}) AS sy, sum({a} * {a}) AS sxx, sum({b} * {b}) AS syy, sum({a} * {b}) AS sxy{extra} FROM {source} GROUP BY {keys}"
    return f"SELECT *, {_PEARSON} AS r FROM (SELECT *, sxx / n - (sx / n) * (sx / n) AS vx, syy / n - (sy / n) * (sy / n) AS vy FROM ({sums}))"


_SPLIT = f"""
, {_CENTER}, e AS (SELECT a.time AS window_end, b.t_idx FROM cube_t a JOIN cube_t b ON b.time BETWEEN a.time - INTERVAL 14 DAYS AND a.time),
g AS (SELECT window_end FROM e GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT e.window_end, c.y, c.x, c.value AS u, ctr.center AS v FROM e JOIN g USING (window_end) JOIN cube c ON c.t_idx = e.t_idx JOIN ctr ON ctr.t_idx = e.t_idx),
f AS (SELECT * FROM p WHERE u IS NOT NULL AND v IS NOT NULL),
k AS (SELECT window_end, y, x, quantile_cont(u, 0.5) AS mu, quantile_cont(v, 0.5) AS mv FROM f GROUP BY 1, 2, 3),
s AS (SELECT f.*, CASE WHEN u <= mu AND v <= mv THEN 'bottom' WHEN u > mu AND v > mv THEN 'top' END AS tail FROM f JOIN k USING (window_end, y, x)),
r AS (SELECT window_end, y, x, tail, {_rank_sql('u', 'window_end, y, x, tail')} AS ru, {_rank_sql('v', 'window_end, y, x, tail')} AS rv FROM s WHERE tail IS NOT NULL),
c2 AS ({_pearson_sql('r', 'window_end, y, x, tail', 'ru', 'rv')}),
d AS (SELECT window_end, y, x, max(CASE WHEN tail = 'bottom' AND n >= 3 THEN r END) AS bottom, max(CASE WHEN tail = 'top' AND n >= 3 THEN r END) AS top FROM c2 GROUP BY 1, 2, 3)
SELECT q.window_end, q.y, q.x, round(bottom, 6) AS bottom, round(top, 6) AS top, round(bottom - top, 6) AS bottom_minus_top FROM (SELECT DISTINCT window_end, y, x FROM p) q LEFT JOIN d ON q.window_end = d.window_end AND q.y = d.y AND q.x = d.x"""


@query("median_split_synchrony", _SPLIT.replace("count(*) >= 5", "count(*) >= 3"))
def median_split_synchrony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded((pipe(_cube(spark, sf_dir)) | rolling.median_split_synchrony("14D", 0.5, 3)).unwrap())


@query("ghosh_tails", f"""
, {_CENTER}, f AS (SELECT c.y, c.x, c.value AS a, ctr.center AS b FROM cube c JOIN ctr ON c.t_idx = ctr.t_idx WHERE c.value IS NOT NULL AND ctr.center IS NOT NULL),
u AS (SELECT y, x, ({_rank_sql('a', 'y, x')}) / (count(*) OVER (PARTITION BY y, x) + 1) AS u, ({_rank_sql('b', 'y, x')}) / (count(*) OVER (PARTITION BY y, x) + 1) AS v FROM f),
m AS (SELECT *, avg(u) OVER w AS mu, avg(v) OVER w AS mv, var_samp(u) OVER w AS su, var_samp(v) OVER w AS sv, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY y, x))
SELECT y, x, CAST(least(floor((u + v) / 2 * 2), 1) AS INTEGER) AS band, round(sum((u - mu) * (v - mv)) / nullif((any_value(n) - 1) * sqrt(any_value(su) * any_value(sv)), 0), 6) AS partial, count(*) AS n_pairs FROM m GROUP BY 1, 2, 3""")
def ghosh_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    pairs = cube.df.join(reduce.center_pixel(cube).select("t_idx", "center"), "t_idx").select("y", "x", F.col("value").alias("u"), F.col("center").alias("v"))
    return rounded(rolling.ghosh_tails(pairs, ["y", "x"]))


# States and events.

_THR = 45.0
_STATE = f"st AS (SELECT *, coalesce(value >= {_THR}, false) AS state, value - {_THR} AS magnitude FROM cube)"


def _states(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> Cube:
    return states.threshold_state(_cube(spark, sf_dir, event_type), _THR)


_OUT = ["time", "y", "x", "state", "magnitude", "threshold"]


@query("threshold_state", f", {_STATE} SELECT time, y, x, state, round(magnitude, 6) AS magnitude, CAST({_THR} AS DOUBLE) AS threshold FROM st")
def threshold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_states(spark, sf_dir).df.select(*_OUT))


@query("field_threshold_state", " SELECT time, y, x, coalesce(value <= 20 + 5 * y, false) AS state, round(20 + 5 * y - value, 6) AS magnitude, CAST(20 + 5 * y AS DOUBLE) AS threshold FROM cube")
def field_threshold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    field = cube.pixels().select("y", "x", (20.0 + 5 * F.col("y")).alias("threshold"))
    return rounded(states.threshold_state(cube, field, "below").df.select(*_OUT))


@query("quantile_state", " SELECT time, y, x, coalesce(value >= q, false) AS state, round(value - q, 6) AS magnitude, round(q, 6) AS threshold FROM cube JOIN (SELECT y, x, quantile_cont(value, 0.75) AS q FROM cube GROUP BY y, x) USING (y, x)")
def quantile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.quantile_state(_cube(spark, sf_dir), 0.75).df.select(*_OUT))


@query("rolling_quantile_state", " SELECT time, y, x, coalesce(value >= q, false) AS state, round(value - q, 6) AS magnitude, round(q, 6) AS threshold FROM (SELECT *, quantile_cont(value, 0.75) OVER (PARTITION BY y, x ORDER BY t_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS q FROM cube)")
def rolling_quantile_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.quantile_state(_cube(spark, sf_dir), 0.75, rolling_window=7).df.select(*_OUT))


@query("binary_state", " SELECT time, y, x, coalesce(value <> 0, true) AS state, CASE WHEN coalesce(value <> 0, true) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS magnitude, 0.0::DOUBLE AS threshold FROM cube")
def binary_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.binary_state(_cube(spark, sf_dir)).df.select(*_OUT))


@query("change_state_absolute", " SELECT time, y, x, coalesce(d >= 10, false) AS state, round(d - 10, 6) AS magnitude, 10.0::DOUBLE AS threshold FROM (SELECT *, value - lag(value, 1) OVER (PARTITION BY y, x ORDER BY t_idx) AS d FROM cube)")
def change_state_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.change_state(_cube(spark, sf_dir), 10.0).df.select(*_OUT))


@query("change_state_relative", " SELECT time, y, x, coalesce(d >= 0.5, false) AS state, round(d - 0.5, 6) AS magnitude, 0.5::DOUBLE AS threshold FROM (SELECT *, (value - b) / nullif(b, 0) AS d FROM (SELECT *, lag(value, 2) OVER (PARTITION BY y, x ORDER BY t_idx) AS b FROM cube))")
def change_state_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.change_state(_cube(spark, sf_dir), 0.5, "relative", "2D").df.select(*_OUT))


@query("heat_stress", f", {_STATE} SELECT time, y, x, state, round(CASE WHEN state THEN magnitude ELSE 0 END, 6) AS magnitude FROM st")
def heat_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.heat_stress(_cube(spark, sf_dir), _THR))


@query("state_transitions", f", {_STATE}, p AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY y, x ORDER BY t_idx) AS to_state FROM st) SELECT from_state, to_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_state), 6) AS probability FROM p WHERE to_state IS NOT NULL GROUP BY 1, 2")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states.state_transitions(_states(spark, sf_dir)))


_EVENTS = f"""
, {_STATE}, a AS (SELECT *, CASE WHEN t_idx - lag(t_idx) OVER (PARTITION BY y, x ORDER BY t_idx) - 1 <= 1 THEN 0 ELSE 1 END AS fresh FROM st WHERE state),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY y, x ORDER BY t_idx) AS island FROM a),
k AS (SELECT y, x, y_idx, x_idx, island, min(t_idx) AS t0, max(t_idx) AS t1, min(time) AS "start", max(time) AS "end", count(*) AS duration FROM i GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2),
ev AS (SELECT k.y, k.x, k.y_idx, k.x_idx, k.t0, k.t1, k."start", k."end", k.duration, max(st.magnitude) AS peak, avg(st.magnitude) AS mean, sum(st.magnitude) AS integral
       FROM k JOIN st ON st.y = k.y AND st.x = k.x AND st.t_idx BETWEEN k.t0 AND k.t1 GROUP BY ALL),
cat AS (SELECT row_number() OVER (ORDER BY y_idx, x_idx, t0) AS event_id, y, x, y_idx AS y_index, x_idx AS x_index, t0, t1, "start", "end", duration, peak, mean, integral,
        CAST(row_number() OVER (PARTITION BY y, x ORDER BY t0) AS INTEGER) AS sequence_index,
        CAST(date_diff('day', lag("end") OVER (PARTITION BY y, x ORDER BY t0), "start") AS DOUBLE) AS time_since_previous_event FROM ev)"""


def _catalog(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> tuple[Cube, DataFrame]:
    s = _states(spark, sf_dir, event_type)
    return s, events.detect_events(s, 2, 1)


@query("detect_events", _EVENTS + ' SELECT event_id, y, x, y_index, x_index, t0, t1, "start", "end", duration, round(peak, 6) AS peak, round(mean, 6) AS mean, round(integral, 6) AS integral, sequence_index, time_since_previous_event FROM cat')
def detect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_catalog(spark, sf_dir)[1])


@query("event_cube", _EVENTS + """ SELECT st.time, st.y, st.x, (cat.event_id IS NOT NULL AND st.state) AS event_active, cat.event_id, cat."start" AS event_start, cat."end" AS event_end, cat.duration AS event_duration,
round(cat.peak, 6) AS event_peak, round(cat.mean, 6) AS event_mean, round(cat.integral, 6) AS event_integral, cat.sequence_index, cat.time_since_previous_event, st.t_idx - cat.t0 AS event_age
FROM st LEFT JOIN cat ON st.y = cat.y AND st.x = cat.x AND st.t_idx BETWEEN cat.t0 AND cat.t1""")
def event_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.event_cube(*_catalog(spark, sf_dir)))


@query("event_centered", _EVENTS + " SELECT cat.event_id, CAST(st.t_idx - cat.t0 AS INTEGER) AS lag, round(st.value, 6) AS value FROM cat JOIN st ON st.y = cat.y AND st.x = cat.x AND st.t_idx BETWEEN cat.t0 - 2 AND cat.t0 + 3")
def event_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, catalog = _catalog(spark, sf_dir)
    return rounded(events.event_centered(_cube(spark, sf_dir), catalog, 2, 3))


# Pairs and synchrony.

_PAIRS = """
px AS (SELECT row_number() OVER (ORDER BY y_idx, x_idx) - 1 AS pixel, y, x, y_idx, x_idx FROM (SELECT DISTINCT y, x, y_idx, x_idx FROM cube)),
pr AS (SELECT a.pixel AS source, b.pixel AS target, a.y AS source_y, a.x AS source_x, b.y AS target_y, b.x AS target_x, a.y_idx AS sy, a.x_idx AS sx, b.y_idx AS ty, b.x_idx AS tx,
       CASE WHEN abs(a.y) <= 90 AND abs(b.y) <= 90 AND abs(a.x) <= 180 AND abs(b.x) <= 180
            THEN 2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2))))
            ELSE sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2)) END AS distance
       FROM px a CROSS JOIN px b)"""
_REF = "(SELECT * FROM pr WHERE ty = (SELECT (max(y_idx) + 1) // 2 FROM cube) AND tx = (SELECT (max(x_idx) + 1) // 2 FROM cube))"
_NEAR = "(SELECT * FROM pr WHERE source < target AND distance <= 250)"


def _pair_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("source", "target", "source_y", "source_x", "target_y", "target_x", "distance"))


_PAIR_COLS = "source, target, source_y, source_x, target_y, target_x, round(distance, 6) AS distance"


@query("pairs_reference", f", {_PAIRS} SELECT {_PAIR_COLS} FROM {_REF}")
def pairs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_out(synchrony.spatial_pairs(_cube(spark, sf_dir), "reference"))


@query("pairs_radius", f", {_PAIRS} SELECT {_PAIR_COLS} FROM {_NEAR}")
def pairs_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_out(synchrony.spatial_pairs(_cube(spark, sf_dir), "neighbors", radius_km=250.0))


@query("pairs_knn", f", {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(distance, 9), target) AS rn FROM pr WHERE source <> target) SELECT DISTINCT {_PAIR_COLS} FROM pr JOIN (SELECT DISTINCT least(source, target) AS s, greatest(source, target) AS t FROM r WHERE rn <= 3) ON source = s AND target = t")
def pairs_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_out(synchrony.spatial_pairs(_cube(spark, sf_dir), "neighbors", k=3))


@query("pairs_all", f", {_PAIRS} SELECT {_PAIR_COLS} FROM pr WHERE source < target")
def pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_out(synchrony.spatial_pairs(_cube(spark, sf_dir), "all_pairs"))


def _occurrence_sql(pairs: str, window: str) -> str:
    return f"""
, {_STATE}, {_PAIRS}, w AS ({window}),
o AS (SELECT w.window_end, p.source, p.target, p.source_y, p.source_x, p.target_y, p.target_x, p.distance, CAST(count(*) AS DOUBLE) AS n,
      CAST(count(CASE WHEN a.state AND b.state THEN 1 END) AS DOUBLE) AS joint, CAST(count(CASE WHEN a.state OR b.state THEN 1 END) AS DOUBLE) AS u,
      CAST(count(CASE WHEN a.state THEN 1 END) AS DOUBLE) AS na, CAST(count(CASE WHEN b.state THEN 1 END) AS DOUBLE) AS nb
      FROM {pairs} p JOIN st a ON a.y = p.source_y AND a.x = p.source_x JOIN st b ON b.y = p.target_y AND b.x = p.target_x AND a.t_idx = b.t_idx JOIN w ON w.t_idx = a.t_idx GROUP BY ALL),
e AS (SELECT *, joint / nullif(u, 0) AS jaccard, joint / nullif(n, 0) AS joint_probability, (n * joint - na * nb) / nullif(sqrt(na * (n - na) * nb * (n - nb)), 0) AS phi FROM o)"""


_ONE_WINDOW = "SELECT (SELECT max(time) FROM cube_t) AS window_end, t_idx FROM cube_t"
_SPANS = "SELECT a.time AS window_end, b.t_idx FROM cube_t a JOIN cube_t b ON b.time BETWEEN a.time - INTERVAL 10 DAYS AND a.time"
_OCC = ' window_end, source, target, source_y, source_x, target_y, target_x, round(distance, 6) AS distance, joint, u AS "union", n, round(jaccard, 6) AS jaccard, round(joint_probability, 6) AS joint_probability, round(phi, 6) AS phi FROM e'


@query("occurrence_reference", _occurrence_sql(_REF, _ONE_WINDOW) + " SELECT" + _OCC)
def occurrence_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synchrony.occurrence_synchrony(_states(spark, sf_dir), "reference").drop("source_label", "target_label"))


@query("occurrence_radius_windows", _occurrence_sql(_NEAR, _SPANS) + " SELECT" + _OCC)
def occurrence_radius_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synchrony.occurrence_synchrony(_states(spark, sf_dir), "neighbors", "10D", radius_km=250.0).drop("source_label", "target_label"))


@query("occurrence_all_pairs", _occurrence_sql("(SELECT * FROM pr WHERE source < target)", _ONE_WINDOW) + " SELECT" + _OCC)
def occurrence_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synchrony.occurrence_synchrony(_states(spark, sf_dir), "all_pairs").drop("source_label", "target_label"))


@query("edge_to_map", _occurrence_sql(_NEAR, _ONE_WINDOW) + " SELECT y, x, round(avg(jaccard), 6) AS jaccard, round(avg(joint), 6) AS joint FROM (SELECT source_y AS y, source_x AS x, jaccard, joint FROM e UNION ALL SELECT target_y, target_x, jaccard, joint FROM e) GROUP BY 1, 2")
def edge_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = synchrony.occurrence_synchrony(_states(spark, sf_dir), "neighbors", radius_km=250.0)
    return rounded(synchrony.edge_to_map(edges, ["jaccard", "joint"]))


@query("reference_map", _occurrence_sql(_REF, _ONE_WINDOW) + " SELECT window_end, source_y AS y, source_x AS x, round(jaccard, 6) AS jaccard FROM e")
def reference_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synchrony.reference_map(synchrony.occurrence_synchrony(_states(spark, sf_dir), "reference"), "jaccard"))


@query("regional_summary", _occurrence_sql("(SELECT * FROM pr WHERE source < target)", _SPANS) + " SELECT window_end, round(avg(jaccard), 6) AS mean_jaccard, round(median(jaccard), 6) AS median_jaccard, count(*) AS n_pairs, round(avg(distance), 6) AS mean_distance FROM e GROUP BY 1")
def regional_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synchrony.regional_occurrence(_states(spark, sf_dir), "10D"))


def _severity_sql(rank: bool) -> str:
    rx, ry = (_rank_sql("x", "source, target"), _rank_sql("y", "source, target")) if rank else ("x", "y")
    return f"""
, {_STATE}, {_PAIRS}, j AS (SELECT p.source, p.target, a.magnitude AS x, b.magnitude AS y FROM {_REF} p JOIN st a ON a.y = p.source_y AND a.x = p.source_x JOIN st b ON b.y = p.target_y AND b.x = p.target_x AND a.t_idx = b.t_idx WHERE a.state AND b.state),
r AS (SELECT *, {rx} AS rx, {ry} AS ry FROM j), c AS ({_pearson_sql('r', 'source, target', 'rx', 'ry', ', avg(x) AS mx, avg(y) AS my, avg(abs(x - y)) AS md')})
SELECT p.source, p.target, CAST(coalesce(n, 0) AS BIGINT) AS n_joint, CASE WHEN n >= 4 THEN round(r, 6) END AS severity, round(mx, 6) AS mean_source, round(my, 6) AS mean_target, round(md, 6) AS mean_abs_difference
FROM {_REF} p LEFT JOIN c ON p.source = c.source AND p.target = c.target"""


def _severity(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    out = synchrony.severity_synchrony(_states(spark, sf_dir), "reference", method, min_joint=4)
    return rounded(out.select("source", "target", "n_joint", "severity", "mean_source", "mean_target", "mean_abs_difference"))


query("severity_spearman", _severity_sql(True))(lambda spark, sf_dir: _severity(spark, sf_dir, "spearman"))
query("severity_pearson", _severity_sql(False))(lambda spark, sf_dir: _severity(spark, sf_dir, "pearson"))


@query("sync_with_lags", f"""
, s AS (SELECT a.time, a.y, a.x, coalesce(a.value >= {_THR}, false) AS p, coalesce(b.value >= {_THR}, false) AS q FROM a JOIN b ON a.time = b.time AND a.y = b.y AND a.x = b.x),
l AS (SELECT y, x, p, q AS q0, lead(q, 1) OVER w AS q1, lead(q, 3) OVER w AS q2, lag(q, 2) OVER w AS q3 FROM s WINDOW w AS (PARTITION BY y, x ORDER BY time)),
u AS (SELECT y, x, 0 AS ord, 0 AS lag, p, q0 AS q FROM l UNION ALL SELECT y, x, 1, 1, p, q1 FROM l UNION ALL SELECT y, x, 2, 3, p, q2 FROM l UNION ALL SELECT y, x, 3, -2, p, q3 FROM l)
SELECT y, x, ord, lag, round(count(CASE WHEN p AND q THEN 1 END) / nullif(CAST(count(CASE WHEN q IS NOT NULL AND (p OR q) THEN 1 END) AS DOUBLE), 0), 6) AS score FROM u GROUP BY 1, 2, 3, 4""", a="view", b="click")
def sync_with_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(synchrony.sync_with(_states(spark, sf_dir, "view"), _states(spark, sf_dir, "click"), [0, 1, 3, -2]))


_MATCH = f"""{_EVENTS}, {_PAIRS},
cand AS (SELECT p.source, p.target, a.event_id AS s, b.event_id AS t, abs(date_diff('day', a."start", b."start")) AS d, date_diff('day', a."start", b."start") AS lag, a.duration AS ds, b.duration AS dt
         FROM {_NEAR} p JOIN cat a ON a.y = p.source_y AND a.x = p.source_x JOIN cat b ON b.y = p.target_y AND b.x = p.target_x WHERE abs(date_diff('day', a."start", b."start")) <= 4),
ord AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY d, s, t) AS k FROM cand),
pick AS (
    WITH RECURSIVE g AS (
        SELECT source, target, 0 AS k, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS ut, CAST([] AS BIGINT[]) AS chosen FROM (SELECT DISTINCT source, target FROM ord)
        UNION ALL
        SELECT g.source, g.target, CAST(o.k AS INTEGER),
               CASE WHEN list_contains(us, o.s) OR list_contains(ut, o.t) THEN us ELSE list_append(us, o.s) END,
               CASE WHEN list_contains(us, o.s) OR list_contains(ut, o.t) THEN ut ELSE list_append(ut, o.t) END,
               CASE WHEN list_contains(us, o.s) OR list_contains(ut, o.t) THEN chosen ELSE list_append(chosen, o.k) END
        FROM g JOIN ord o ON o.source = g.source AND o.target = g.target AND o.k = g.k + 1)
    SELECT source, target, unnest(chosen) AS k FROM (SELECT source, target, arg_max(chosen, k) AS chosen FROM g GROUP BY 1, 2)),
mt AS (SELECT ord.* FROM ord JOIN pick USING (source, target, k))"""


@query("match_events", _MATCH + " SELECT source, target, s AS source_event_id, t AS target_event_id, CAST(lag AS INTEGER) AS lag_days, CAST(d AS INTEGER) AS abs_lag_days FROM mt")
def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, catalog = _catalog(spark, sf_dir)
    pairs = synchrony.spatial_pairs(s, "neighbors", radius_km=250.0)
    return synchrony._matched(catalog, pairs, 4).select("source", "target", "source_event_id", "target_event_id", "lag_days", "abs_lag_days")


@query("timing_synchrony", _MATCH + f""", c AS (SELECT y, x, count(*) AS n FROM cat GROUP BY 1, 2), g AS (SELECT source, target, avg(exp(-d / 7.0)) AS timing, avg(lag) AS ml, median(d) AS md, count(*) AS n FROM mt GROUP BY 1, 2)
SELECT p.source, p.target, round(timing, 6) AS timing, round(ml, 6) AS mean_lag, round(md, 6) AS median_abs_lag, coalesce(g.n, 0) AS n_matched, coalesce(a.n, 0) - coalesce(g.n, 0) AS unmatched_source, coalesce(b.n, 0) - coalesce(g.n, 0) AS unmatched_target
FROM {_NEAR} p LEFT JOIN g ON p.source = g.source AND p.target = g.target LEFT JOIN c a ON a.y = p.source_y AND a.x = p.source_x LEFT JOIN c b ON b.y = p.target_y AND b.x = p.target_x""")
def timing_synchrony(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = synchrony.timing_synchrony(*_catalog(spark, sf_dir), "neighbors", 4, radius_km=250.0)
    return rounded(out.select("source", "target", "timing", "mean_lag", "median_abs_lag", "n_matched", "unmatched_source", "unmatched_target"))


@query("duration_synchrony", _MATCH + f""", m2 AS (SELECT source, target, CAST(ds AS DOUBLE) AS ds, CAST(dt AS DOUBLE) AS dt FROM mt), g AS ({_pearson_sql('m2', 'source, target', 'ds', 'dt', ', avg(1 - abs(ds - dt) / greatest(ds, dt, 1)) AS sim, avg(ds - dt) AS md')})
SELECT p.source, p.target, CAST(coalesce(n, 0) AS BIGINT) AS n_matched, CASE WHEN n >= 3 THEN round(r, 6) END AS correlation, round(sim, 6) AS similarity, round(md, 6) AS mean_difference FROM {_NEAR} p LEFT JOIN g ON p.source = g.source AND p.target = g.target""")
def duration_synchrony(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = synchrony.duration_synchrony(*_catalog(spark, sf_dir), "neighbors", 4, radius_km=250.0)
    return rounded(out.select("source", "target", "n_matched", "correlation", "similarity", "mean_difference"))


# Blocks and alignment.

_BLOCKS = ", bs AS (SELECT concat('b', y_idx // 5, '_', x_idx // 5) AS block, time, median(value) AS value FROM cube GROUP BY 1, 2)"


@query("block_signature", _BLOCKS + " SELECT block, time, round(value, 6) AS value FROM bs")
def block_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.block_signatures(_cube(spark, sf_dir), 5, 5))


@query("aoi_signature", " SELECT time, round(median(value), 6) AS value, round((SELECT avg(y) FROM cube_p), 6) AS y_center, (SELECT min(y) FROM cube_p) AS y_min, (SELECT max(y) FROM cube_p) AS y_max, round((SELECT avg(x) FROM cube_p), 6) AS x_center, (SELECT min(x) FROM cube_p) AS x_min, (SELECT max(x) FROM cube_p) AS x_max, 'aoi' AS unit FROM cube GROUP BY time")
def aoi_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.aoi_signature(_cube(spark, sf_dir)))


_COMPARE = "CAST(n AS BIGINT) AS n, round(r, 6) AS pearson_r, round(md, 6) AS mean_difference, round(rmse, 6) AS rmse"


@query("compare_blocks", _BLOCKS + f""", j AS (SELECT a.block AS left_block, b.block AS right_block, a.value AS p, b.value AS q FROM bs a JOIN bs b ON a.time = b.time AND a.block < b.block WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
c AS ({_pearson_sql('j', 'left_block, right_block', 'p', 'q', ', avg(p - q) AS md, sqrt(avg((p - q) * (p - q))) AS rmse')}) SELECT left_block, right_block, 'value' AS variable, {_COMPARE}, concat(left_block, '__', right_block) AS pair FROM c""")
def compare_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blocks.compare_blocks(blocks.block_signatures(_cube(spark, sf_dir), 5, 5), ["value"]))


@query("compare_signatures", f""", j AS (SELECT 'value' AS variable, p, q FROM (SELECT time, median(value) AS p FROM a GROUP BY 1) JOIN (SELECT time, median(value) AS q FROM b GROUP BY 1) USING (time) WHERE p IS NOT NULL AND q IS NOT NULL),
c AS ({_pearson_sql('j', 'variable', 'p', 'q', ', avg(p - q) AS md, sqrt(avg((p - q) * (p - q))) AS rmse')}) SELECT variable, {_COMPARE} FROM c""", a="view", b="click")
def compare_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (blocks.aoi_signature(_cube(spark, sf_dir, t)) for t in ("view", "click"))
    return rounded(blocks.compare_signatures(a, b, ["value"]))


def _asof_sql(choice: str) -> str:
    return f""", l AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS time FROM events WHERE event_type = 'error'), k AS (SELECT user_id, CAST(ts AS DATE) AS time, max(value) AS v FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
b AS (SELECT l.user_id, l.time, max(k.time) AS tb FROM l JOIN k ON k.user_id = l.user_id AND k.time <= l.time GROUP BY 1, 2), f AS (SELECT l.user_id, l.time, min(k.time) AS tf FROM l JOIN k ON k.user_id = l.user_id AND k.time >= l.time GROUP BY 1, 2),
c AS (SELECT l.user_id, l.time, {choice} AS tc FROM l LEFT JOIN b ON b.user_id = l.user_id AND b.time = l.time LEFT JOIN f ON f.user_id = l.user_id AND f.time = l.time)
SELECT c.user_id, c.time, CASE WHEN abs(date_diff('day', c.tc, c.time)) <= 5 THEN round(k.v, 6) END AS value FROM c LEFT JOIN k ON k.user_id = c.user_id AND k.time = c.tc"""


def _asof(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("time", F.to_date("ts"))
    left = e.where("event_type = 'error'").select("user_id", "time").distinct()
    right = e.where("event_type = 'signup'").groupBy("user_id", "time").agg(F.max("value").alias("value"))
    return rounded(align.asof_join(left, right, ["user_id"], "value", method, 5))


query("align_pad", _asof_sql("tb"))(lambda spark, sf_dir: _asof(spark, sf_dir, "pad"))
query("align_backfill", _asof_sql("tf"))(lambda spark, sf_dir: _asof(spark, sf_dir, "backfill"))
query("align_nearest", _asof_sql("CASE WHEN tf IS NULL OR date_diff('day', tb, l.time) <= date_diff('day', l.time, tf) THEN tb ELSE tf END"))(lambda spark, sf_dir: _asof(spark, sf_dir, "nearest"))


@query("bilinear", """, p AS (SELECT event_id AS point_id, CAST(ts AS DATE) AS time, user_id % 4 + 0.25 AS py, user_id % 9 + 0.5 AS px FROM events WHERE event_type = 'error'),
k AS (SELECT point_id, time, py, px, floor(py) + dy AS y, floor(px) + dx AS x, (CASE dy WHEN 0 THEN 0.75 ELSE 0.25 END) * 0.5 AS w FROM p, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT k.point_id, k.time, CAST(any_value(py) AS DOUBLE) AS py, CAST(any_value(px) AS DOUBLE) AS px, CASE WHEN count(c.value) = 4 THEN round(sum(c.value * w), 6) END AS value FROM k LEFT JOIN cube c ON c.time = k.time AND c.y = k.y AND c.x = k.x GROUP BY 1, 2""")
def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'")
    points = e.select(F.col("event_id").alias("point_id"), F.to_date("ts").alias("time"), (F.col("user_id") % 4 + 0.25).cast("double").alias("py"), (F.col("user_id") % 9 + 0.5).cast("double").alias("px"))
    out = align.bilinear(points, _cube(spark, sf_dir))
    # Points on days without any cell stay, without a value.
    return rounded(out.select("point_id", "time", "py", "px", "value"))


__all__ = ["ORACLES", "PIXEL", "QUERIES", "rounded"]
