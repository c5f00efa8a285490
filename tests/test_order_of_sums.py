"""Queries whose thresholds and ties meet means of doubles: the layout of the events' files must not show."""

import datetime
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera import queries_cube, queries_more  # noqa: F401
from tessera.sources.cubes import demo_cells

duckdb = pytest.importorskip("duckdb")

NAMES = [
    "change_state_absolute", "change_state_relative", "detect_events", "event_cube", "footprint_crop", "heat_stress", "percent_rank_average",
    "prepared_pair", "quantile_state", "suitability", "threshold_state", "median_split_synchrony", "state_transitions", "rolling_quantile_state",
]


@pytest.fixture(scope="module")
def layouts(tmp_path_factory):
    """The same events in order and backwards; each cell has three whose mean is 20, 30, 45, 55 or 60 but for rounding."""
    rng, rows = random.Random(7), []
    for day in range(24):
        cells = []
        for user in range(25):
            mean = rng.choice([20, 30, 45, 55, 60])
            a, b = rng.randrange(1, 100 * mean), rng.randrange(1, 100 * mean)
            cells += [(user, v / 100) for v in (a, b, 300 * mean - a - b)]
        rng.shuffle(cells)
        rows += [(datetime.datetime(2024, 1, 1 + day, 6), *c) for c in cells]
    table = pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([r[0] for r in rows], pa.timestamp("us")), "user_id": pa.array([r[1] for r in rows], pa.int64()),
        "event_type": ["view"] * len(rows), "value": [r[2] for r in rows],
    })
    out = []
    for name, t in (("ordered", table), ("backwards", table.sort_by([("event_id", "descending")]))):
        home = tmp_path_factory.mktemp(name)
        pq.write_table(t, home / "events.parquet")
        out.append(str(home))
    return out


@pytest.mark.parametrize("name", NAMES)
def test_rows_do_not_depend_on_the_layout(spark, layouts, name):
    found = []
    for home in layouts:
        df = queries_cube.QUERIES[name](spark, home)
        found.append(sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()))
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{layouts[0]}/events.parquet'")
    out = con.sql(queries_cube.ORACLES[name])
    at = [out.columns.index(c) for c in sorted(out.columns)]
    sql = sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall())
    assert found[0] == found[1] and found[0] == sql


def test_means_keep_the_order_when_memory_is_full(spark, layouts):
    """The setting has aggregations by hash spill every 5 rows."""
    setting = "spark.sql.TungstenAggregate.testFallbackStartsAt"
    spark.conf.set(setting, "2,5")
    try:
        found = {(r["time"], r["y"], r["x"]): r["value"] for r in demo_cells(spark, layouts[0], None).collect()}
    finally:
        spark.conf.unset(setting)
    con = duckdb.connect(config={"threads": 1})
    sql = con.sql(f"SELECT CAST(ts AS DATE), user_id % 5, user_id // 5, avg(value) FROM '{layouts[0]}/events.parquet' GROUP BY ALL").fetchall()
    assert found == {r[:3]: r[3] for r in sql}
