"""The pipeline's stages, one after the other, against brute force."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import mixing, queries

from .test_operators import WORD, brute_components, brute_counts, brute_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [[tuple(r) for r in docs.select("doc_id", "text", "source").collect()]]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns == columns or k == 4
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append([tuple(r) for r in docs.select("doc_id", "text", "source").collect()] if k < 4 else docs.collect())
    raw, good, single, stripped, mixed, packed = seen

    assert set(good) <= set(raw)
    assert all(n >= 50 and 100 * r <= 50 * n for n, _, _, _, r in (brute_counts(t) for _, t, _ in good))
    low = brute_components([(d, t) for d, t, _ in good])
    assert {d for d, _, _ in single} == {d for d in low if low[d] == d} and set(single) <= set(good)

    text = {d: t for d, t, _ in single}
    removed = {r[0]: r for r in brute_repeats(sorted((d, t) for d, t, _ in single))}
    for d, t, _ in stripped:
        assert len(text[d].encode()) - len(t.encode()) >= removed[d][2]
        assert removed[d][2] or t == text[d]

    plan = mixing.plan_mix(spark.createDataFrame(stripped, "doc_id long, text string, source string")).toPandas()
    words = Counter()
    for d, t, _ in mixed:
        words[d] += len(WORD.findall(t))
    assert words == Counter({d: int(n) for d, n in zip(plan.doc_id, plan.taken, strict=True) if n})
    assert Counter({d: n for d, n in words.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in packed), Counter())


def test_run_is_registered_and_whole(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    names = [n.split("_")[0] for n in queries.queries()]
    assert sorted(names) == sorted(f"op{k}" for k in range(1, 11))
