"""Sharding by sampled splitters, law ``bytes``: shards of near-equal size.

Records are ordered by (crc32 of the text, doc_id).  A size-weighted sample of keys gives
quantile splitters; the splitters range-partition the records; a range that turns out
overfull is subdivided with further samples taken inside it.  Running sums inside the
ranges plus the offsets of the ranges place every record exactly, so the shards do not
depend on the sample: it only decides how the work is dealt out.

Equal texts are neighbours in this order.  A shard boundary that falls inside such a group
moves to the nearer edge of the group when that costs at most ``tolerance`` of a shard;
larger groups are divided.

Edge cases: a null text has size 1 and the checksum of the empty text; a null id sorts
first; repeated rows are separate records, and those equal in text and id stay in one range;
a record is never divided, so one larger than a shard's share can leave shards beside it
without a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, shuffle_partitions

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _constant(values: list, kind: str) -> Column:
    """A table as one literal, so that the plan does not grow with it; the planner parses it once."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the row's key, by binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    table = _constant([{"a": a, "b": b} for a, b in splitters], "array<struct<a: bigint, b: bigint>>")
    key = F.struct(F.col("crc").alias("a"), F.col("sid").alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(table, mid) <= key
        done = acc["lo"] >= acc["hi"]
        return F.struct(
            F.when(~done & below, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(~done & ~below, mid).otherwise(acc["hi"]).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.lit(len(splitters).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splitters)).alias("hi"))
    return F.aggregate(steps, start, halve)["lo"]


def _sample(recs: DataFrame, n: int, total: int, seed: int) -> list[tuple[int, int]]:
    """About ``n`` keys, at most, drawn without replacement with chances in proportion to size.

    The priorities are exponential with rate size, so about 2 n rows of ``total`` bytes lie
    below 2 n / total: no task sends more than its share of these.
    """
    u = (F.shiftrightunsigned(F.xxhash64("sid", "crc", "size", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    drawn = recs.select("crc", "sid", (-F.log(u) / F.col("size")).alias("p")).where(F.col("p") <= 2.0 * n / total)
    rows = drawn.orderBy("p", "crc", "sid").limit(n).collect()
    return sorted((r["crc"], r["sid"]) for r in rows)


def shard(df: DataFrame, n_shards: int = 8, tolerance: float = 0.01, rows_per_range: int = 1_000_000, oversample: int = 32) -> DataFrame:
    """Deal all rows of ``df(doc_id, text)`` into ``n_shards`` shards of near-equal bytes."""
    spark = df.sparkSession
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    recs = cut(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            crc.alias("crc"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("sid"),
        )
    )
    total, rows = recs.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)

    n_ranges = max(shuffle_partitions(spark), -(-rows // rows_per_range))
    drawn = _sample(recs, oversample * n_ranges, total, seed=0)
    splitters = sorted({drawn[i * len(drawn) // n_ranges] for i in range(1, n_ranges)} if drawn else set())
    for attempt in range(1, 4):
        ranged = recs.withColumn("rng", _range_of(splitters))
        fill = {r["rng"]: r for r in ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct("crc", "sid")).alias("lo"), F.max(F.struct("crc", "sid")).alias("hi")).collect()}
        overfull = {k: r for k, r in fill.items() if r["bytes"] > 2 * total / n_ranges and tuple(r["lo"]) < tuple(r["hi"])}
        if not overfull or attempt == 3:
            break
        parts = sum(-(-r["bytes"] * n_ranges // total) for r in overfull.values())
        more = _sample(ranged.where(F.col("rng").isin(list(overfull))), oversample * parts, sum(r["bytes"] for r in overfull.values()), seed=attempt)
        splitters = sorted({*splitters, *more[oversample // 2 :: oversample]})

    ids = sorted(fill)
    before = dict(zip(ids, accumulate([0] + [fill[k]["bytes"] for k in ids]), strict=False))
    ahead = dict(zip(ids, accumulate([0] + [fill[k]["n"] for k in ids]), strict=False))
    starts = lambda d: _constant([d.get(k, 0) for k in range(ids[-1] + 1)], "array<bigint>")
    order = Window.partitionBy("rng").orderBy("crc", "sid", "size")
    placed = cut(
        ranged.withColumns(
            {
                "_run": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                "_rn": F.row_number().over(order).cast("long"),
            }
        ).select(
            "doc_id",
            "size",
            "crc",
            (F.get(starts(before), F.col("rng")) + F.col("_run")).alias("pos"),
            (F.get(starts(ahead), F.col("rng")) + F.col("_rn") - 1).alias("idx"),
        )
    )

    # Twice the boundaries, so that the middle of a record compares in whole numbers.
    edges = [-(-2 * i * total // n_shards) for i in range(1, n_shards)]
    straddles = F.lit(False)
    for e in edges:
        straddles = straddles | ((2 * F.col("pos") < e) & (2 * (F.col("pos") + F.col("size")) > e))
    hit = [r["crc"] for r in placed.where(straddles).select("crc").collect()]
    groups = placed.where(F.col("crc").isin(hit)).groupBy("crc").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("size")).alias("b"), F.count("*").alias("n")).collect() if hit else []
    slack = 2 * tolerance * total / n_shards
    for i, e in enumerate(edges):
        near = min((x for g in groups if g["n"] > 1 and 2 * g["a"] < e < 2 * g["b"] for x in (2 * g["a"], 2 * g["b"])), key=lambda x: abs(x - e), default=None)
        if near is not None and abs(near - e) <= slack:
            edges[i] = near
    shard_of = sum((F.when(2 * F.col("pos") + F.col("size") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    dealt = placed.withColumn("shard", shard_of)
    first = {r["shard"]: r["i"] for r in dealt.groupBy("shard").agg(F.min("idx").alias("i")).collect()}
    first_idx = F.array(*[F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)])
    return dealt.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("idx") - F.get(first_idx, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
