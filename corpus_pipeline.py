"""From raw documents to packed training sequences.

Five stages, each an operator of ``tessera.llm`` over all rows that its predecessor kept.
Each stage's result is written as Parquet and read again, so a lost executor costs at most
the stage at work.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, quality, suffixes
from tessera.llm.shared import discard, scratch_dir, scratch_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules accept."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that smaller ids have too."""
    return suffixes.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables behind the result of the last stage that this thread of control called.
_behind: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("behind", default=())


def tidy(stage: Stage) -> Stage:
    """The stage, which first drops the scratch tables of the stage before: its result is written by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, list(_behind.get()))
        with scratch_scope() as made:
            out = stage(spark, docs, sf_dir)
        _behind.set(tuple(made))
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", tidy(quality_rules)),
    ("n-gram Jaccard join", tidy(near_duplicates)),
    ("suffix-array dedup", tidy(repeated_passages)),
    ("mixing sources", tidy(source_mix)),
    ("best-fit packing", tidy(packed)),
]

#: The quality stage iterates to a fixed point, and near copies need components: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
