"""Matching of many pairs at once: as one pair at a time, and without shuffling candidates."""

import numpy as np
import pytest

from tessera import queries_cube
from tessera.operators.events import greedy, greedy_rounds


@pytest.mark.parametrize("longest", [0, 1, 6, 40])
def test_rounds_equal_one_pair_at_a_time(longest):
    rng = np.random.default_rng(longest)
    na, nb = rng.integers(0, longest + 1, 60), rng.integers(0, longest + 1, 60)
    a, b = (np.sort(rng.integers(0, 3 * longest + 1, (60, longest)), axis=1).astype(np.int32) for _ in range(2))
    pair, i, j = greedy_rounds(a, na, b, nb, 4)
    for p in range(60):
        near = [(abs(int(a[p, x]) - int(b[p, y])), x, y) for x in range(na[p]) for y in range(nb[p]) if abs(int(a[p, x]) - int(b[p, y])) <= 4]
        assert sorted(zip(i[pair == p].tolist(), j[pair == p].tolist(), strict=True)) == sorted(greedy(near))


@pytest.mark.parametrize("name", ["match_events", "timing_synchrony", "duration_synchrony"])
def test_candidates_and_matches_are_not_shuffled(spark, name):
    """After the squares in which pairs meet, nothing is dealt or sorted again."""
    plan = queries_cube.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("source#")] if "source#" in plan else plan
    assert "Window" not in above and "Repartition" not in above and plan.count("MapInArrow") == 1 and "Sort [source" not in plan
