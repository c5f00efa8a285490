"""Regional summaries without pairs, and pairs' words as columns."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tessera import queries_cube
from tessera.operators import states, synchrony
from tessera.plans.cube import dense


def _states(spark, days):
    rng = np.random.default_rng(days)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=t), y, 60 * x, float(rng.integers(0, 9))) for t in range(days) for y in range(3) for x in range(5)]
    return states.threshold_state(dense(spark.createDataFrame(rows, "time date, y long, x long, value double")), 6.0)


def test_patterns_equal_pairs(spark):
    for days, window in ((9, "3D"), (70, None), (70, 66)):
        s = _states(spark, days)
        want = synchrony.regional_summary(synchrony.occurrence_synchrony(s, "regional", window), "jaccard").orderBy("window_end").collect()
        got = synchrony.regional_occurrence(s, window).orderBy("window_end").collect()
        assert [(r["window_end"], r["n_pairs"]) for r in got] == [(r["window_end"], r["n_pairs"]) for r in want]
        for a, b in zip(got, want, strict=True):
            for c in ("mean_jaccard", "median_jaccard", "mean_distance"):
                assert a[c] == b[c] or abs(a[c] - b[c]) < 1e-9


def test_registered_summary_makes_no_pairs_of_pixels(spark):
    plan = queries_cube.QUERIES["regional_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "source" not in plan


def test_windows_over_words_are_not_interpreted(spark):
    for days, longest in ((70, 16), (150, 1)):
        s, was = _states(spark, days), synchrony.WORDS
        synchrony.WORDS = longest
        try:
            out = synchrony.occurrence_synchrony(s, "all_pairs", 100)
            assert ("zip_with" in out._jdf.queryExecution().optimizedPlan().toString()) == (longest == 1)
            found = out.groupBy("window_end").agg(F.sum("joint"), F.sum("n")).collect()
        finally:
            synchrony.WORDS = was
        assert len(found) == days and all(r[2] == 105 * min(100, k + 1) for k, r in enumerate(sorted(found)))
