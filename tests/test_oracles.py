"""All registered queries of the reference's operators against their SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tessera import queries_cube, queries_development, queries_lake, queries_more  # noqa: E402, F401
from tessera.oracles import finished, output_columns  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = queries_cube.QUERIES | queries_lake.QUERIES
ORACLES = queries_cube.ORACLES | queries_lake.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    out = duck.sql(ORACLES[name])
    assert sorted(out.columns) == sorted(df.columns)
    at = [out.columns.index(c) for c in sorted(out.columns)]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in out.fetchall())


def test_columns_of_a_statement():
    sql = "WITH a AS (SELECT 1 AS q) SELECT x.time, round(f(a, 'b,c'), 6) AS v, \"start\" FROM x"
    assert output_columns(sql) == ["time", "v", "start"] and finished(sql).startswith('SELECT * REPLACE (CAST("time"')
