"""Ward's nearest clusters are found by bounds of groups: no work in the square of the rows, and no other result."""

import time

import numpy as np

from tessera.ml import models


def test_nearest_by_groups_equals_all_pairs():
    rng = np.random.default_rng(2)
    centers, sizes = np.concatenate([rng.normal(size=(700, 3)), rng.integers(0, 4, size=(300, 3)).astype(float)]), rng.choice([1.0, 1, 1, 2, 3, 40, 900], 1000)
    cost = ((centers[:, None] - centers[None]) ** 2).sum(-1) * (sizes[:, None] * sizes[None]) / (sizes[:, None] + sizes[None])
    np.fill_diagonal(cost, np.inf)
    asked = rng.random(1000) < 0.7
    groups = models._leaves(centers, sizes)
    assert sorted(groups[0]) == list(range(1000))
    out = models._nearest(centers, sizes, asked, *groups, 0, len(groups[1]) - 1)
    assert sorted(out["i"]) == np.flatnonzero(asked).tolist()
    np.testing.assert_allclose(out["least"], cost.min(axis=1)[out["i"]], atol=1e-12)
    np.testing.assert_allclose(cost[out["i"], out["best"]], out["least"], atol=1e-12)


def test_copies_of_rows_share_a_cluster(spark):
    rng = np.random.default_rng(4)
    some = rng.normal(size=(300, 2))
    pts = np.concatenate([some[rng.permutation(300)] for _ in range(200)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, a double, b double")
    start = time.time()
    out = {r["id"]: r["cluster"] for r in models.ward_clusters(df, "id", ["a", "b"], 5).collect()}
    # 60,000 rows: all pairs of them take minutes.
    assert time.time() - start < 30
    label = {tuple(p): out[i] for i, p in enumerate(pts)}
    assert len(out) == 60_000 and all(label[tuple(p)] == out[i] for i, p in enumerate(pts)) and len(set(out.values())) == 5
