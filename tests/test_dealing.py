"""Distances of all rows: by tiles and bands, as brute force has them, and without a row for each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.dealing import distance_sums
from tessera.lake import tables
from tessera.ml import models
from tessera.operators import selections


def _frame(spark, pts, groups):
    return spark.createDataFrame([(i, f"g{g}", *map(float, p)) for i, (g, p) in enumerate(zip(groups, pts, strict=True))], "id long, k string, a double, b double, c double").repartition(3)


def _points(n=150):
    rng = np.random.default_rng(11)
    pts = np.round(rng.normal(size=(n, 3)) * 4) / 4
    pts[20:40] = pts[19]
    return pts, rng.integers(0, 4, n)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sums_of_distances_by_tiles():
    pts, groups = _points(90)
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.diff(groups[order], prepend=-1))
    d = np.sqrt(((pts[order][:, None] - pts[order][None]) ** 2).sum(-1))
    for own in (False, True):
        parts = [distance_sums(pts[order].T, starts, own, a, b) for a, b in ((0, 7), (7, 7), (7, 90))]
        got = {(int(i), int(g)): v for p in parts for i, g, v in zip(p["i"], p["g"], p["d"], strict=True)}
        ends = [*starts[1:], 90]
        want = {(i, g): d[i, a:b].sum() for i in range(90) for g, (a, b) in enumerate(zip(starts, ends, strict=True)) if not own or a <= i < b}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_medoids(spark):
    pts, groups = _points()
    df = _frame(spark, pts, groups)
    out = tables.medoid(df, "id", ["a", "b"], ["k"])
    assert "aggregate" not in _plan(out).lower().replace("aggregate [", "")
    got = {r["k"]: (r["id"], r["total_distance"]) for r in out.collect()}
    for g in range(4):
        at = np.flatnonzero(groups == g)
        total = np.sqrt(((pts[at][:, None, :2] - pts[at][None, :, :2]) ** 2).sum(-1)).sum(1)
        best = min(zip(np.round(total, 9), at, strict=True))
        assert got[f"g{g}"][0] == best[1] and abs(got[f"g{g}"][1] - total.min()) < 1e-9
    assert tables.medoid(df.limit(0), "id", ["a", "b"], ["k"]).collect() == []


def test_silhouettes(spark):
    pts, groups = _points()
    groups[0] = 9
    df = _frame(spark, pts, groups)
    out = models.silhouettes(df, "id", ["a", "b", "c"], "k")
    assert "zip_with" not in _plan(out)
    rows = out.collect()
    assert len(rows) == len(pts) and [r["silhouette"] for r in rows if r["id"] == 0] == [0.0]
    assert abs(np.mean([r["silhouette"] for r in rows]) - models.silhouette(pts, groups)) < 1e-9
    loose = df.withColumn("k", F.when(F.col("id") % 50 != 1, F.col("k")))
    assert len(models.silhouettes(loose, "id", ["a", "b", "c"], "k").collect()) == len(pts)


@pytest.mark.parametrize("k", [1, 3, 400])
def test_nearest_of_few_columns(spark, k):
    pts, groups = _points()
    df = _frame(spark, pts, groups)
    asked = df.where("id % 7 = 0")
    out = models.knn_columns(asked, df, "id", ["a", "b"], k)
    assert "Join" not in _plan(out)
    vectors = [x.withColumn("v", F.array("a", "b")) for x in (asked, df)]
    key = lambda x: sorted(map(tuple, x.select("query_id", "rank", "neighbor_id", "distance").collect()))
    assert key(out) == key(models.knn(*vectors, "id", "v", k))


def test_mismatch_examples(spark):
    pts, groups = _points()
    df = _frame(spark, pts, groups)
    out = selections.mismatch_examples(df.where("id % 10 = 0"), df, "id", ["a", "b"], ["c"], 12)
    assert "zip_with" not in _plan(out)
    got = {r["id_a"]: r["id_b"] for r in out.collect()}
    z = (pts - pts.mean(0)) / pts.std(0)
    for i in range(0, len(pts), 10):
        near = sorted((round(float(np.hypot(*(z[i, :2] - z[j, :2]))), 9), j) for j in range(len(pts)) if j != i)[:12]
        assert got[i] == min((-round(abs(float(z[i, 2] - z[j, 2])), 9), j) for _, j in near)[1]
