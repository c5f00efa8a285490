"""Helpers that the corpus operators share: lineage cuts, scratch tables, word patterns."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut, scratch_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What one batch of rows may take on its way to a Python worker, where rows are large.
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside sends rows to Python in batches of a few MB.

    By default a batch holds up to 64 MB, which the JVM and the worker each keep twice while
    one batch follows the other; rows of a megabyte need no such batches.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give memory that a Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Paths made since the innermost :func:`scratch_scope` of this thread of control began.
_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the scratch paths made inside, for :func:`discard` once their results are written."""
    outer, inner = _made.get(), []
    token = _made.set(inner)
    try:
        yield inner
    finally:
        _made.reset(token)
        if outer is not None:
            outer.extend(inner)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}_{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS `{path.rpartition('/')[2]}`")
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int, deal: bool = True) -> DataFrame:
    """Write ``df`` hash-bucketed by ``key``: later joins on it do not move these rows again.

    ``deal``: rows go to their bucket's task first, so that a bucket is one file; without it
    nothing is shuffled and each task writes its share of every bucket.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2]
    rows = df.repartition(buckets, key) if deal else df
    rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def row_key(*columns: Column) -> list[Column]:
    """Two hashes that name a row by its content (96 bits); nulls are values like others."""
    marked = [F.struct(c.isNull().alias("n"), c.alias("v")) for c in columns]
    return [F.xxhash64(*marked).alias("_k1"), F.hash(*marked).alias("_k2")]


def with_key(df: DataFrame, *names: str) -> DataFrame:
    """(row, _k1, _k2): rows as structs, whatever their columns are called, with the key of some of these."""
    columns = [F.col("doc_id").cast("long") if n == "doc_id" else F.col(n) for n in names]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *row_key(*columns))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some of them changed."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in columns])
