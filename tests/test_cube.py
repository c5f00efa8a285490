"""Cube verbs on the literal fixtures, with answers worked out by hand."""

import datetime as dt

import numpy as np
import pytest

from tessera.operators import align, blocks, events, geometry, reduce, rolling, states, synchrony, tubes
from tessera.plans.cube import Cube, dense, from_frame, merge
from tessera.plans.pipe import Pipe, apply, pipe, tap

DAY = dt.date(2001, 1, 1)


def day(i, start=DAY):
    return start + dt.timedelta(days=i)


def cube_of(spark, values, start=DAY, ys=None, xs=None, descending=()):
    """A cube from nested lists (time, y, x)."""
    rows = [(day(t, start), float(ys[i] if ys else i), float(xs[j] if xs else j), None if v is None else float(v)) for t, plane in enumerate(values) for i, row in enumerate(plane) for j, v in enumerate(row)]
    return dense(spark.createDataFrame(rows, "time date, y double, x double, value double"), descending=descending)


def grid(df, column, *keys):
    return {tuple(r[k] for k in keys): r[column] for r in df.collect()}


@pytest.fixture(scope="module")
def ordinal(spark):
    return cube_of(spark, np.arange(24).reshape(4, 2, 3).tolist())


HEAT = [[[30, 36], [38, 32]], [[36, 37], [39, 30]], [[37, 20], [40, 31]], [[20, 38], [41, 32]], [[36, 39], [20, 33]], [[37, 40], [42, 34]]]


@pytest.fixture(scope="module")
def heat(spark):
    return cube_of(spark, HEAT, dt.date(2024, 1, 1), [40.0, 40.5], [-105.0, -104.5])


def test_reductions(ordinal):
    assert grid(reduce.mean(ordinal), "value", "y", "x") == {(y, x): 9 + 3 * y + x for y in (0, 1) for x in (0, 1, 2)}
    assert set(grid(reduce.variance(ordinal), "value", "y", "x").values()) == {45.0}
    assert all(abs(v - 35 / 12) < 1e-12 for v in grid(reduce.variance(ordinal, dim="space"), "value", "time").values())
    assert reduce.mean(ordinal, keep_dim=True).count() == 6
    with pytest.raises(ValueError):
        reduce.mean(ordinal, dim=["time", "y"], keep_dim=True)


def test_missing_values(spark):
    c = cube_of(spark, [[[1, None]], [[float("nan"), None]], [[3, None]]])
    assert grid(reduce.mean(c), "value", "x") == {(0.0,): 2.0, (1.0,): None}
    assert grid(reduce.mean(c, skipna=False), "value", "x") == {(0.0,): None, (1.0,): None}
    assert set(grid(reduce.zscore(c).df, "value_zscore", "t_idx", "x").values()) == {-1.0, None, 1.0}
    assert not any(grid(states.threshold_state(c, 10.0).df, "state", "t_idx", "x").values())
    assert all(grid(states.binary_state(c).df, "state", "t_idx", "x").values())


def test_constant_pixel_has_no_score(spark):
    c = cube_of(spark, [[[5]], [[5]], [[5]]])
    assert set(grid(reduce.zscore(c).df, "value_zscore", "t_idx").values()) == {None}
    assert set(grid(rolling.rolling_corr_vs_center(c, 5, 2), "corr", "time").values()) == {None}


def test_pipe_equals_direct_call(ordinal):
    piped = (pipe(ordinal) | reduce.anomaly() | reduce.variance()).unwrap()
    assert sorted(map(tuple, piped.collect())) == sorted(map(tuple, reduce.variance(reduce.anomaly(ordinal)).collect()))
    seen = []
    out = pipe(ordinal) | tap(lambda c: seen.append(c) or "view") | apply(lambda c: c.df.count())
    assert out.unwrap() == 24 and seen == [ordinal] and isinstance(out, Pipe)
    with pytest.raises(TypeError):
        pipe(ordinal) | 3


def test_partitioning_does_not_change_results(spark, heat):
    again = Cube(heat.df.repartition(7))
    for verb in (reduce.zscore(), reduce.rolling_mean(3, 1), reduce.temporal_difference(1)):
        a, b = ((pipe(c) | verb).unwrap().df for c in (heat, again))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_positions_follow_a_descending_axis(spark):
    c = cube_of(spark, [[[1], [2]]], ys=[40.0, 39.0], descending=("y",))
    assert grid(c.df, "y_idx", "y") == {(40.0,): 0, (39.0,): 1}


def test_axes_by_other_names(spark):
    df = spark.createDataFrame([(DAY, 1.0, 2.0, 3.0)], "date date, lat double, lon double, t2m double")
    assert from_frame(df, ("t2m",)).df.select("time", "y", "x", "t2m").first() == (DAY, 1.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        from_frame(df.withColumnRenamed("lat", "foo"), ("t2m",))


def test_rolling_and_stride(ordinal):
    r = grid(reduce.rolling_mean(ordinal, 2).df, "value", "t_idx", "y", "x")
    assert r[0, 0.0, 0.0] is None and r[1, 0.0, 0.0] == 3.0
    assert {t for (t,) in grid(reduce.time_stride(ordinal, 2).df, "value", "t_idx")} == {0, 2}


def test_blocks_of_pixels(spark):
    c = cube_of(spark, [np.arange(15).reshape(3, 5).tolist()])
    assert grid(reduce.coarsen_mean(c, 2, 2), "value", "by", "bx") == {(0, 0): 3.0, (0, 1): 5.0}
    smooth = grid(reduce.smooth_mean(c, 3), "value_smooth", "y", "x")
    assert smooth[1.0, 1.0] == 6.0 and smooth[0.0, 1.0] is None
    with pytest.raises(ValueError):
        reduce.smooth_mean(c, 2)


def test_heat_events(heat):
    s = states.threshold_state(heat, 35.0)
    assert grid(s.df.where("state").groupBy("y", "x").count(), "count", "y", "x") == {(40.0, -105.0): 4, (40.0, -104.5): 5, (40.5, -105.0): 5}
    rows = sorted(events.detect_events(s, 2, 1).collect(), key=lambda r: r["event_id"])
    assert [(r["event_id"], r["duration"], r["peak"], r["integral"]) for r in rows] == [(1, 4, 2.0, -9.0), (2, 5, 5.0, 0.0), (3, 5, 7.0, 10.0)]
    assert [r["start"].day for r in rows] == [2, 1, 1] and {r["end"].day for r in rows} == {6}
    cells = events.event_cube(s, events.detect_events(s, 2, 1)).where("event_id is not null and not event_active")
    assert cells.count() == 3


def test_gaps_and_no_events(heat, spark):
    s = states.threshold_state(heat, 35.0)
    assert events.detect_events(s, 1, 0).count() == 6
    none = events.detect_events(states.threshold_state(heat, 99.0), 1, 0)
    assert none.count() == 0 and "event_id" in none.columns
    assert synchrony.timing_synchrony(states.threshold_state(heat, 99.0), none, "all_pairs").where("timing is not null").count() == 0


def test_heat_synchrony(heat):
    s = states.threshold_state(heat, 35.0)
    out = grid(synchrony.occurrence_synchrony(s, "reference", reference=(1, 0)), "jaccard", "source_y", "source_x")
    assert {k: round(v, 6) for k, v in out.items()} == {(40.5, -105.0): 1.0, (40.0, -105.0): 0.5, (40.0, -104.5): 0.666667, (40.5, -104.5): 0.0}
    assert synchrony.spatial_pairs(heat, "reference", reference=0).select("target").distinct().first()[0] == 0


def test_lagged_states(heat):
    left = states.threshold_state(heat, 35.0)
    from pyspark.sql import functions as F

    right = left.with_df(left.df.withColumn("state", F.coalesce(F.lag("state").over(left.along_time()), F.lit(False))))
    scores = grid(synchrony.sync_with(left, right, [0, 1]).groupBy("lag").agg(F.avg("score").alias("m")), "m", "lag")
    assert scores[1,] > scores[0,] and scores[1,] == 1.0
    assert set(grid(synchrony.best_lag(synchrony.sync_with(left, right, [0, 1])).where("best_score is not null"), "best_lag", "y", "x").values()) == {1}


def test_greedy_matching_is_one_to_one():
    assert events.greedy([(1, 1, 10), (1, 2, 10), (2, 2, 11), (0, 3, 11)]) == [(3, 11), (1, 10)]


def test_tail_correlations(spark):
    rows = [(0, float(x), float(y)) for x, y in zip([0, 1, 2, 3, 10, 11, 12, 13], [0, 1, 2, 3, 13, 12, 11, 10], strict=True)]
    out = rolling.tail_spearman(spark.createDataFrame(rows, "k int, u double, v double"), ["k"], 0.5, 3).first()
    assert (out["bottom"], out["top"], out["bottom_minus_top"]) == (1.0, -1.0, 2.0)


def test_signatures_compare(spark):
    make = lambda offset, name: blocks.block_signature(cube_of(spark, [[[t + s / 5 + offset for s in row] for row in ((0, 1), (2, 3))] for t in range(6)]), name)
    every = blocks.collect_blocks([make(0, "a"), make(2, "b"), make(1, "c")])
    out = {r["pair"]: r for r in blocks.compare_blocks(every, ["value"]).collect()}
    assert set(out) == {"a__b", "a__c", "b__c"}
    assert (round(out["a__b"]["pearson_r"], 9), round(out["a__b"]["mean_difference"], 9), round(out["a__b"]["rmse"], 9), out["a__b"]["n"]) == (1.0, -2.0, 2.0, 6)
    with pytest.raises(ValueError):
        blocks.collect_blocks([make(0, "a"), make(1, "a")])


def test_tubes(spark):
    mask = np.zeros((2, 3, 3), int)
    mask[0, 0, 0] = mask[0, 2, 2] = mask[1, 1, 1] = 1
    c = reduce.mask_by_threshold(cube_of(spark, mask.tolist()), 0.5)
    assert tubes.label_tubes(c, 6).select("tube_id").distinct().count() == 3
    assert tubes.label_tubes(c, 26).select("tube_id").distinct().count() == 1
    labels = [[[1, 0], [0, 0]], [[1, 1], [0, 0]], [[0, 2], [2, 0]]]
    rows = [(day(t), float(y), float(x), v) for t, p in enumerate(labels) for y, r in enumerate(p) for x, v in enumerate(r) if v]
    m = {r["tube_id"]: r for r in tubes.tube_metrics(spark.createDataFrame(rows, "time date, y double, x double, tube_id long")).collect()}
    assert [(m[k]["duration_steps"], m[k]["n_voxels"]) for k in (1, 2)] == [(2, 3), (1, 2)]


def test_polygon_mask_has_its_border(spark):
    c = cube_of(spark, np.zeros((3, 5, 5)).tolist())
    ring = [{"x": a, "y": b} for a, b in ((1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0))]
    polygons = spark.createDataFrame([(day(0), ring), (day(2), ring)], "time date, ring array<struct<x:double,y:double>>")
    for interp in ("nearest", "linear"):
        inside = geometry.vase_mask(c, polygons, interp).df.where("mask")
        assert inside.count() == 27 and inside.agg({"y": "min"}).first()[0] == 1.0
    assert polygons.select(geometry.area(polygons["ring"]).alias("a")).first()["a"] == 4.0


def test_hull_of_points():
    assert geometry.convex_hull([(0, 0), (1, 1), (2, 2)]) == [(0, 0), (2, 2)]
    assert set(geometry.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("a", day(0)), ("a", day(2)), ("a", day(9)), ("b", day(0))], "k string, time date")
    right = spark.createDataFrame([("a", day(1), 1.0), ("a", day(3), 3.0)], "k string, time date, v double")
    get = lambda m: [grid(align.asof_join(left, right, ["k"], "v", m, 5), "v", "k", "time")[k] for k in (("a", day(0)), ("a", day(2)), ("a", day(9)), ("b", day(0)))]
    assert get("pad") == [None, 1.0, None, None] and get("backfill") == [1.0, 3.0, None, None] and get("nearest") == [1.0, 1.0, None, None]


def test_interpolation(spark):
    s = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0), ("b", 0.5, 7.0)], "k string, pos double, value double")
    out = grid(align.interpolate_grid(s, ["k"], [-1, 0.25, 2]), "value", "k", "grid")
    assert out == {("a", -1.0): 0.0, ("a", 0.25): 2.5, ("a", 2.0): 10.0, ("b", -1.0): 7.0, ("b", 0.25): 7.0, ("b", 2.0): 7.0}


def test_merge_needs_distinct_names(ordinal):
    with pytest.raises(ValueError):
        merge(ordinal, ordinal)
