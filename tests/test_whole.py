"""Registered queries that answer for every row, not for a part of them."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest

from tessera import queries_lake
from tessera.ml import models


def test_ward_by_rounds_equals_one_pair_at_a_time(spark):
    pts = np.random.default_rng(7).normal(size=(260, 3)) * [1, 2, 3]
    pts[40:43] = pts[39]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double, c double").repartition(3)
    for k, local in ((4, 4096), (4, 100), (17, 0), (1, 4096), (300, 4096)):
        out = {r["id"]: r["cluster"] for r in models.ward_clusters(df, "id", ["a", "b", "c"], k, local).collect()}
        assert [out[i] for i in range(260)] == models.ward(pts, k).tolist()
    assert models.ward_clusters(df.limit(0), "id", ["a", "b", "c"], 4).collect() == []


def test_ward_clusters_has_every_customer(spark, tmp_path):
    day = dt.date(2024, 1, 1)
    rows = [(c, c * 3 + i, day + dt.timedelta(days=(c * 7 * i) % 90), float((c * 7919 + i * 104729) % 100_003)) for c in range(260) for i in range(3)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderdate date, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    out = {r["fire_id"]: r["cluster"] for r in queries_lake.QUERIES["ward_clusters"](spark, str(tmp_path)).collect()}
    z = models.standardised(queries_lake.traits(spark, str(tmp_path)), queries_lake._COLS).orderBy("fire_id").toPandas()
    assert len(out) == 260 and [out[i] for i in z["fire_id"]] == models.ward(z[queries_lake._COLS].to_numpy(), 4).tolist()


def _zones(rows):
    """Cells by event, day and zone of (user, day, type), by brute force."""
    grid = {(u % 5, u // 5) for u, _, _ in rows}
    first: dict = {}
    for u, day, kind in rows:
        if kind == "error":
            key = (u % 3, (u % 5, u // 5))
            first[key] = min(day, first.get(key, day))
    out: Counter = Counter()
    for event, day in {(u % 3, day) for u, day, kind in rows if kind == "error"}:
        for y, x in grid:
            reached = first.get((event, (y, x)))
            near = [d for (e, (b, a)), d in first.items() if e == event and abs(b - y) <= 1 and abs(a - x) <= 1]
            if reached is not None and reached <= day:
                out[event, day, "cumulative"] += 1
                out[event, day, "active"] += reached == day
            elif any(d <= day for d in near):
                out[event, day, "extension"] += 1
    return {k: n for k, n in out.items() if n}


def test_exposure_zones_of_every_day(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(d), str(k)) for u, d, k in zip(rng.integers(0, 60, 150), rng.integers(0, 25, 150), rng.choice(["error", "view"], 150), strict=True)]
    data = [(u, dt.datetime(2024, 1, 1, 5) + dt.timedelta(days=d), k) for u, d, k in rows]
    spark.createDataFrame(data, "user_id long, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    out = {(r["event_id"], r["day"], r["zone"]): r["n_cells"] for r in queries_lake.QUERIES["exposure_zones"](spark, str(tmp_path)).collect()}
    assert out == _zones(rows)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    tenth = {(e, d, z): n for e, d, z, n in con.sql(queries_lake.EXPOSURE_TENTH_SQL).fetchall()}
    assert tenth and tenth == {k: n for k, n in out.items() if k[1] % 10 == 0}
