"""Mixing sources to target weights with hash-random keys and exact cuts.

Each document gets a random key (a hash of its id).  Per source, the documents in key
order are a random permutation; the mix takes whole passes over it (epochs) and then its
beginning, up to the source's budget in words.  The key's leading bits deal each source
into equal key ranges: sums per range, prefix-summed, show in which range the cut falls,
and only that one range of each source has to be sorted; there are the more ranges the more
rows there are.  The document at the cut gives
just the words that are still missing.

Edge cases: a null text has no words; null is a source of its own, ordered last; documents
without words take part with 0; repeated rows are separate documents; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut, row_key, unpacked, with_key, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Add ``target`` to ``sizes(skey, source, source_size)``, one row for each source.

    The budget, ``share`` of all words, is split by weight; a target stops at
    ``max_epochs`` times its source's size and what is left over is shared again.
    With sources in the order of cap / weight, the level (words per unit of weight) is the
    largest of (budget - caps before) / (weights from here on) that its own cap allows.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "_ord")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_ord") - 1) % len(weights))
    return (
        sizes.withColumn("_ord", F.row_number().over(by_name))
        .withColumn("_w", weight)
        .withColumn("_cap", (max_epochs * F.col("source_size")).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", share * F.sum("source_size").over(everything))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_caps")) / F.col("_left"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap")))
        .select("skey", "source_size", "target")
    )


#: Up to so many sources, some megabytes, their plan is broadcast; beyond, it is joined with the rows dealt by salt.
FEW_SOURCES = 1 << 15
#: Rows of a key range, in expectation.
RANGE_ROWS = 1 << 16


def _with_plan(recs: DataFrame, plan: DataFrame, salts: int = 32) -> DataFrame:
    """Each row with its source's plan; no task gets all rows of a large source."""
    if plan.count() <= FEW_SOURCES:
        return recs.join(F.broadcast(plan), "skey")
    dealt = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return recs.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(dealt, ["skey", "_salt"]).drop("_salt")


def plan_mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", range_rows: int = RANGE_ROWS) -> DataFrame:
    """How many words the mix takes of each row of ``df(doc_id, text, source)``.

    Returns doc_id, size, source_size, target, taken and the row's content key (_k1, _k2).
    """
    recs = cut(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            *row_key(F.col("doc_id").cast("long"), F.col("source"), F.col("text")),
        )
        .withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))))
    )
    # Key ranges go by leading hexadecimal digits, as many as keep a range of all rows together small.
    digits = max(3, math.ceil(math.log(max(1, recs.count() / range_rows), 16)))
    recs = recs.withColumn("cell", F.conv(F.substring("key", 1, digits), 16, 10).cast("long"))
    cells = cut(recs.groupBy("skey", "source", "cell").agg(F.sum("size").alias("words")))
    sizes = cells.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    budget = targets(sizes, weights, share, max_epochs).withColumn("_take", F.round("target").cast("long"))
    safe = F.greatest("source_size", F.lit(1))
    budget = budget.withColumn("epochs", F.floor(F.col("_take") / safe)).withColumn("rest", F.col("_take") - F.col("epochs") * F.col("source_size"))
    along = Window.partitionBy("skey").orderBy("cell")
    cut_at = (
        cells.withColumn("before", F.sum("words").over(along) - F.col("words"))
        .join(budget.select("skey", "rest"), "skey")
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select("skey", F.col("cell").alias("cut_cell"), "before")
    )
    # The left-over is below the source's size, so that a cut exists unless there are no words.
    plan = cut(budget.join(cut_at, "skey", "left").withColumn("cut_cell", F.coalesce("cut_cell", F.lit(-1))))
    rows = _with_plan(recs.drop("source"), plan)
    inside = F.col("cell") == F.col("cut_cell")
    order = Window.partitionBy("skey", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = rows.where(inside).withColumn("_pos", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    at_cut = at_cut.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("_pos")))).drop("_pos")
    others = rows.where(~inside).withColumn("part", F.when(F.col("cell") < F.col("cut_cell"), F.col("size")).otherwise(F.lit(0)))
    return at_cut.unionByName(others).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "_k1", "_k2"
    )


def mix(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, the row at a cut shortened to its words."""
    # Repeated rows have one key; counted within it, each gets the share of one of them.  Rows that differ in
    # other columns only are taken in the order of a hash of those, so that reruns agree.
    number = lambda *order: F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(*order))
    plan = plan_mix(df, **options).withColumn("_nth", number(F.col("taken").desc())).where("taken > 0").select("_k1", "_k2", "_nth", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    others = [F.col("row")[f.name] for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.name != "text"]
    rows = with_key(df, "doc_id", "source", "text").withColumn("_nth", number(F.xxhash64(*others))).join(plan, ["_k1", "_k2", "_nth"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1)))
    words = F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size"))
    pieces = F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(words < F.col("_size"), F.array_join(F.slice(pieces, 1, words.cast("int")), "")).otherwise(F.col("row.text"))
    return unpacked(rows, df.columns, text=text, n_chars=F.length(text).cast("long"))
