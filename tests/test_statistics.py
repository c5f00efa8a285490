"""Statistics, numbering, geometry and pairs against plain Python on small frames."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.graph import connected
from tessera.functions.numbering import numbered
from tessera.functions.stats import array_pearson, array_ranks, quantile
from tessera.ml import models, nulls
from tessera.operators import development, events, geometry, synchrony
from tessera.plans.cube import dense


def test_numbers_follow_the_order(spark):
    rows = [(int(g), int(x)) for g, x in np.random.default_rng(1).permutation([(g, x) for g in range(7) for x in range(11)])]
    out = numbered(spark.createDataFrame(rows, "g int, x int").repartition(5), "g", ["x"], "n", start=0).collect()
    assert [(r["g"], r["x"]) for r in sorted(out, key=lambda r: r["n"])] == sorted(rows) and {r["n"] for r in out} == set(range(77))


def test_components_of_a_graph(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 20)]
    for last in (4, 1000):
        out = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long"), last_edges=last).collect()}
        assert out == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 120), 100)}


def test_ranks_and_correlation_of_arrays(spark):
    x, y = [3.0, 1.0, 3.0, 7.0], [1.0, 2.0, 2.0, 9.0]
    row = spark.createDataFrame([(x, y), ([], []), ([1.0, 1.0], [1.0, 2.0])], "x array<double>, y array<double>").select(array_ranks(F.col("x")).alias("r"), array_pearson(F.col("x"), F.col("y")).alias("c")).collect()
    assert row[0]["r"] == [2.5, 1.0, 2.5, 4.0] and abs(row[0]["c"] - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert row[1]["r"] == [] and row[1]["c"] is None and row[2]["c"] is None


def test_approximate_quantiles_have_a_bounded_rank_error(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("v"))
    exact, near = df.agg(quantile("v", 0.3).alias("e"), quantile("v", 0.3, 1000).alias("n")).first()
    assert exact == 3000.0 and abs(near - 3000) <= 10


def test_p_values():
    for rho, n, p in ((0.1, 100, 0.32222), (0.5, 10, 0.14111), (-0.9, 5, 0.03739), (0.0, 50, 1.0)):
        assert abs(nulls.correlation_p_value(rho, n) - p) < 1e-4
    assert nulls.correlation_p_value(1.0, 9) == 0.0 and nulls.correlation_p_value(None, 9) is None and nulls.correlation_p_value(0.3, 2) is None


def test_spectrum_and_determinant(spark):
    s = nulls.spectrum(np.array([0.5, 0.3, 0.2]))
    assert s["pc1"] == 0.5 and abs(s["participation_ratio"] - 1 / 0.38) < 1e-12 and s["dim95"] == 3 and abs(s["cumvar_pc1_5"] - 1) < 1e-12
    pts = np.random.default_rng(0).normal(size=(200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double, c double")
    assert abs(nulls.logdet_covariance(df, ["a", "b", "c"]) - np.linalg.slogdet(np.cov(pts, rowvar=False))[1]) < 1e-6
    c = nulls.correlations(df, ["a", "b", "c"])
    assert np.allclose(c, np.corrcoef(pts, rowvar=False))
    assert nulls.representative_columns(c, ["a", "b", "c"], 2.0) == ["a", "b", "c"]
    assert nulls.representative_columns(np.array([[1, 0.9, 0.1], [0.9, 1, 0.95], [0.1, 0.95, 1]]), ["a", "b", "c"]) == ["b"]


def _slices(spark, n=30):
    rng = np.random.default_rng(4)
    rows = [(f, i, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.integers(0, 5))) for f in range(n) for i in range(int(rng.integers(1, 12)))]
    df = spark.createDataFrame(rows, "fire_id long, slice_index long, timestamp date, ring_area_km2 double")
    return rows, df


@pytest.mark.parametrize("kind", nulls.NULL_GROWTH)
def test_null_growth_keeps_totals_and_lengths(spark, kind):
    rows, df = _slices(spark)
    out = nulls.null_growth(df, kind).collect()
    total, length = Counter(), Counter(f for f, *_ in rows)
    for f, _, _, v in rows:
        total[f] += v
    assert Counter(r["fire_id"] for r in out) == length
    for f in length:
        own = sorted((r for r in out if r["fire_id"] == f), key=lambda r: r["slice_index"])
        assert abs(sum(r["ring_area_km2"] for r in own) - total[f]) < 1e-6 and all(r["ring_area_km2"] >= 0 for r in own)
        assert [r["slice_index"] for r in own] == list(range(length[f]))
        if kind == "shuffled order":
            assert sorted(r["ring_area_km2"] for r in own) == sorted(v for g, _, _, v in rows if g == f)
    plain = lambda frame: sorted((r["fire_id"], r["slice_index"], round(r["ring_area_km2"], 9)) for r in frame)
    assert plain(nulls.null_growth(df.repartition(3), kind).collect()) == plain(out)


def test_permuted_columns_keep_their_values(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(40)], "id long, a double, b double")
    out = nulls.permuted(df, "id", ["a", "b"], 2).toPandas()
    for _, g in out.groupby("rep"):
        assert sorted(g["a"]) == [float(i) for i in range(40)] and sorted(g["b"]) == [float(i * i) for i in range(40)] and (g["a"] ** 2 != g["b"]).any()


def test_silhouettes_equal_the_dense_ones(spark):
    rng = np.random.default_rng(3)
    pts, labels = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(pts, labels, strict=True))], "id long, a double, b double, k int")
    assert abs(models.silhouettes(df, "id", ["a", "b"], "k").agg(F.avg("silhouette")).first()[0] - models.silhouette(pts, labels)) < 1e-9


def test_farthest_first_and_assignment(spark):
    pts = [(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 0.0, 10.0), (3, 1.0, 1.0), (4, 4.0, 4.0)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    chosen = models.farthest_first(df, "id", ["a", "b"], 3)
    assert chosen[0] in (3, 4) and set(chosen[1:]) == {1, 2}
    out = {r["id"]: r["representative"] for r in models.assigned(df, df.where(F.col("id").isin(chosen)), "id", ["a", "b"]).collect()}
    assert all(out[c] == c for c in chosen)


def test_rings_at_equal_steps(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in square])
    out = spark.range(1).select(geometry.resampled(ring, 8).alias("r")).first()["r"]
    assert [(p["x"], p["y"]) for p in out] == [(0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2)]
    line = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 3.0), (2, 5.0, 5.0)], "g int, y double, x double")
    assert geometry.hulls(line, ["g"]).count() == 0
    areas = {r["g"]: r["a"] for r in geometry.hulls(line, ["g"], 0.5).select("g", geometry.area(F.col("ring")).alias("a")).collect()}
    assert areas == {1: 4.0, 2: 1.0}


def test_pulses_of_a_plateau_and_of_one_slice(spark):
    rows = [(1, i, dt.date(2020, 1, 1 + i), v) for i, v in enumerate([0.0, 5.0, 5.0, 0.0, 0.0, 4.0, 0.0])] + [(2, 0, dt.date(2020, 1, 1), 3.0), (3, 0, dt.date(2020, 1, 1), 0.0), (3, 1, dt.date(2020, 1, 2), 0.0)]
    df = spark.createDataFrame([(f, i, t, v, v) for f, i, t, v in rows], "fire_id long, slice_index long, timestamp date, ring_area_km2 double, cumulative_area_km2 double")
    s = {r["fire_id"]: r for r in development.pulse_summary(df).collect()}
    assert s[1]["prominence"] == [2, 6] and s[1]["pulses"] == [2, 3, 6] and s[1]["final"] == 6 and s[1]["quiet"] == 7 and s[1]["again"] == []
    assert s[2]["pulses"] == [1] and s[2]["quiet"] is None and s[3]["pulses"] == [1, 2] and s[3]["final"] == 1 and s[3]["quiet"] == 2
    states = {(r["fire_id"], r["slice_index"]): r["developmental_state"] for r in development.developmental_states(development.pulse_summary(df)).collect()}
    assert states[1, 1] == "major expansion" and states[1, 3] == "low activity" and states[1, 6] == "quiescence"


def test_nearest_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    cells = sorted({(int(y), int(x)) for y, x in rng.integers(1000, 1400, (90, 2))})
    cube = dense(spark.createDataFrame([(dt.date(2020, 1, 1), y, x, 1.0) for y, x in cells], "time date, y long, x long, value double"))
    want = set()
    for i, a in enumerate(cells):
        near = sorted((round(math.dist(a, b), 9), j) for j, b in enumerate(cells) if j != i)[:4]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    got = {(r["source"], r["target"]) for r in synchrony.spatial_pairs(cube, "neighbors", k=4).collect()}
    assert got == want


def test_long_series_of_states_go_beyond_the_columns(spark):
    rng = np.random.default_rng(2)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    values = {(y, i): (None if rng.random() < 0.1 else float(rng.random())) for y in range(2) for i in range(200)}
    rows = [(days[i], y, 0, v) for (y, i), v in values.items() if v is not None]
    cube = dense(spark.createDataFrame(rows, "time date, y long, x long, value double"))
    states = cube.with_values(state=F.col("value") > 0.5, magnitude=F.col("value"))
    out = {r["window_end"]: r for r in synchrony.occurrence_synchrony(states, "all_pairs", "70D").collect()}
    for k in (10, 69, 130, 199):
        span = range(max(0, k - 70), k + 1)
        both = [(values[0, i], values[1, i]) for i in span]
        joint = sum(1 for a, b in both if a is not None and b is not None and a > 0.5 and b > 0.5)
        union = sum(1 for a, b in both if (a is not None and a > 0.5) or (b is not None and b > 0.5))
        assert out[days[k]]["joint"] == joint and abs(out[days[k]]["jaccard"] - joint / union) < 1e-12


def test_matching_is_the_greedy_one_in_every_group(spark):
    rng = np.random.default_rng(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=int(n))
    side = lambda: [(int(g), i, day(n), day(n + 1), 2) for i, (g, n) in enumerate(zip(rng.integers(0, 5, 60), rng.integers(0, 40, 60), strict=True))]
    a, b = side(), side()
    schema = "g long, event_id long, start date, end date, duration int"
    got = {(r["g"], r["source_event_id"], r["target_event_id"]) for r in events.match_events(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["g"], 6).collect()}
    want = set()
    for g in range(5):
        pairs = [(abs((t[2] - s[2]).days), s[1], t[1]) for s in a for t in b if s[0] == t[0] == g and abs((t[2] - s[2]).days) <= 6]
        want |= {(g, s, t) for s, t in events.greedy(pairs)}
    assert got == want and len(want) > 30
